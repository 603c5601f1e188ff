"""Words and swatches of a legend: which words name which colour.

Swatches meet swatches and words by image and row bucket: a swatch goes into the buckets of its own height class that its rows touch, a word into the one bucket
of each class, and what meets is compared exactly. The assignment is a fold in swatch order (a word goes to one swatch only, and words beyond a gap stay free): the pairs of an image stream
through one task, sorted, which holds the words that are taken. Names without near repeats are such a fold too, which holds the kept names' beginnings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernglass.functions import text as rules
from fernglass.functions.colour import rounded
from fernglass.operators.components import dealt
from fernglass.operators.folds import in_order

ROW, REACH, GAP = 25, 0.15, 50


def banded(spans: DataFrame, points: DataFrame) -> DataFrame:
    """Spans (image_id, low, high, ...) joined with the points (image_id, at, ...) of their image that lie inside, by image, height class and bucket."""
    width = lambda level: F.pow(F.lit(2.0), level)
    level = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("high") - F.col("low")))).cast("int")  # a span touches two buckets, three at most
    spans = spans.withColumn("level_", level)
    levels = spans.select("image_id", "level_").distinct()
    cell = lambda c: F.floor(F.col(c) / width(F.col("level_")))
    left = spans.where("low <= high").withColumn("cell_", F.explode(F.sequence(cell("low"), cell("high"))))
    right = points.join(levels, "image_id").withColumn("cell_", cell("at"))
    return left.join(dealt(right), ["image_id", "level_", "cell_"]).where(F.col("at").between(F.col("low"), F.col("high"))).drop("level_", "cell_")


def right_boundaries(swatches: DataFrame, sizes: DataFrame) -> DataFrame:
    """Swatches in reading order (`ord` from 0, rows of 25 pixels) with `right_boundary`.

    It is 15 % of the image's width from the swatch's right side, or 5 pixels before the first later swatch in order whose middle is less than
    1.2 heights away and which starts to the right, if that is nearer."""
    order = Window.partitionBy("image_id").orderBy(F.floor(F.col("min_y") / ROW), "min_x", "idx")
    rows = swatches.withColumn("ord", F.row_number().over(order) - 1).withColumn("mid", (F.col("min_y") + F.col("max_y")) / 2)
    reach = (F.col("max_y") - F.col("min_y")) * 1.2
    spans = rows.select("image_id", "ord", "max_x", "mid", reach.alias("reach"), (F.col("mid") - reach).alias("low"), (F.col("mid") + reach).alias("high"))
    others = rows.select("image_id", F.col("ord").alias("ord_b"), F.col("mid").alias("at"), F.col("min_x").alias("min_x_b"))
    later = (F.col("ord_b") > F.col("ord")) & (F.abs(F.col("at") - F.col("mid")) < F.col("reach")) & (F.col("min_x_b") > F.col("max_x"))
    beside = banded(spans, others).where(later).groupBy("image_id", "ord").agg(F.min_by("min_x_b", "ord_b").alias("beside"))
    far = F.col("max_x") + F.col("width") * REACH
    return rows.join(sizes.select("image_id", "width"), "image_id").join(dealt(beside), ["image_id", "ord"], "left").withColumn("right_boundary", F.least(far, F.coalesce(F.col("beside") - 5, far))).drop("beside", "width", "mid")


ASSIGNED = "ord int, word_idx int, place int"


def assign_words(bounded: DataFrame, words: DataFrame) -> DataFrame:
    """(image_id, ord, word_idx, place): the words of each swatch, from the left.

    words: (image_id, word_idx, text, confidence, x0, y0, x1, y1). A word belongs if it starts at most 5 pixels left of the swatch's right side,
    not beyond its boundary, with its middle within the swatch's height and min(10, 0.3 heights) more. Words after a gap of more than 50
    pixels are not taken and stay free for later swatches."""
    pad = F.least(F.lit(10.0), 0.3 * (F.col("max_y") - F.col("min_y")))
    spans = bounded.select("image_id", F.col("ord").cast("int").alias("ord"), (F.col("min_y") - pad).alias("low"), (F.col("max_y") + pad).alias("high"), F.col("max_x").alias("right_x"), "right_boundary")
    points = words.select("image_id", "word_idx", "x0", "x1", ((F.col("y0") + F.col("y1")) / 2).alias("at"))
    pairs = banded(spans, points).where((F.col("x0") >= F.col("right_x") - 5) & (F.col("x0") <= F.col("right_boundary")))
    return in_order(pairs, "image_id", [F.asc("ord"), F.asc("x0"), F.asc("word_idx")], ["ord", "word_idx", "x0", "x1"], _Taken, ASSIGNED)


class _Taken:
    """Words of swatch after swatch, from the left: free ones before the first wide gap are taken."""

    def __init__(self):
        self.taken, self.ord, self.place, self.end, self.over = set(), None, 0, 0, False

    def row(self, ord: int, word: int, x0: float, x1: float):
        if ord != self.ord:
            self.ord, self.place, self.over = ord, 0, False
        if not self.over and word not in self.taken:
            if self.place and x0 - self.end > GAP:
                self.over = True
            else:
                self.taken.add(word)
                self.place, self.end = self.place + 1, x1
                yield ord, word, self.place - 1


def named(assigned: DataFrame, words: DataFrame) -> DataFrame:
    """(image_id, ord, raw, name, confidence, valid): texts joined by spaces, cleaned, with the rounded mean confidence."""
    rows = assigned.join(dealt(words), ["image_id", "word_idx"])
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda w: w["text"]), " ")
    out = rows.groupBy("image_id", "ord").agg(rules.trimmed(raw).alias("raw"), rounded(F.avg("confidence")).alias("confidence")).withColumn("name", rules.clean(F.col("raw")))
    return out.withColumn("valid", rules.valid(F.col("name")))


def gap_cut(words: DataFrame, keys: tuple[str, ...], most: int = GAP) -> DataFrame:
    """The words of each key, from the left, before the first gap of more than `most` pixels."""
    by = Window.partitionBy(*keys).orderBy("x0", "word_idx")
    wide = F.coalesce((F.col("x0") - F.lag("x1").over(by) > most).cast("int"), F.lit(0))
    return words.withColumn("wide_", wide).withColumn("cut_", F.max("wide_").over(by.rowsBetween(Window.unboundedPreceding, 0))).where("cut_ = 0").drop("wide_", "cut_")


def without_near_names(entries: DataFrame, key: str = "image_id", order: str = "ord", name: str = "name", also: tuple[str, ...] = ()) -> DataFrame:
    """(key, order, name, also...) of entries that repeat no kept one: letters only, equal, or one the other's beginning and fewer than 5 letters shorter."""
    plain = F.regexp_replace(F.lower(F.col(name)), "[^a-z]", "")
    kinds = [f"`{c}` {entries.schema[c].dataType.simpleString()}" for c in (order, name, *also)]
    rows = entries.select(key, order, name, plain.alias("plain_"), *also)
    return in_order(rows, key, [F.col(order).asc_nulls_last(), F.col("plain_").asc_nulls_last(), F.col(name).asc_nulls_last()], [order, name, "plain_", *also], _Kept, ", ".join(kinds))


class _Kept:
    """Kept names and their beginnings that are up to four letters shorter: a trie of which only what is asked for is held, so a name costs ten lookups."""

    SHORTER = 4

    def __init__(self):
        self.names, self.beginnings = set(), set()

    def row(self, order, name, plain, *also):
        if plain is not None:
            own = [plain[: len(plain) - k] for k in range(min(self.SHORTER, len(plain)) + 1)]
            if plain in self.beginnings or any(p in self.names for p in own):
                return
            self.names.add(plain)
            self.beginnings.update(own)
        yield order, name, *also


def parse(swatches: DataFrame, sizes: DataFrame, words: DataFrame) -> DataFrame:
    """Legend entries of images: (image_id, ord, name, confidence, cr, cg, cb, min_x, max_x, min_y, max_y).

    Names that are not valid are left out after their words have been taken; then near repeats are."""
    return entries(right_boundaries(swatches, sizes), words)


def entries(bounded: DataFrame, words: DataFrame) -> DataFrame:
    """`parse` of swatches that have their boundaries."""
    kept = without_near_names(named(assign_words(bounded, words), words).where("valid"), also=("confidence",))
    return kept.join(dealt(bounded.select("image_id", "ord", "cr", "cg", "cb", "min_x", "max_x", "min_y", "max_y")), ["image_id", "ord"])


def parse_counts(bounded: DataFrame, found: DataFrame, kept: DataFrame) -> DataFrame:
    """(image_id, swatches, no_text, rejected, valid, deduped) of a parse."""
    a = bounded.groupBy("image_id").agg(F.count("*").alias("swatches"))
    b = found.groupBy("image_id").agg(F.count("*").alias("named"), F.count_if(~F.col("valid")).alias("rejected"), F.count_if("valid").alias("valid"))
    c = kept.groupBy("image_id").agg(F.count("*").alias("kept"))
    rows = a.join(b, "image_id", "left").join(c, "image_id", "left").fillna(0)
    return rows.select("image_id", "swatches", (F.col("swatches") - F.col("named")).alias("no_text"), "rejected", "valid", (F.col("valid") - F.col("kept")).alias("deduped"))


def lines_of_words(words: DataFrame, line_height: str | float, share: float = 0.6) -> DataFrame:
    """words (image_id, word_idx, y0, y1, ...) in their own order, with `line` from 0: a new line starts where a word's middle is `share` line
    heights or more away from the middle of the line's first word. `line_height` is a number or a column that an image's words share."""
    height = F.col(line_height) if isinstance(line_height, str) else F.lit(float(line_height))
    rows = words.select("image_id", F.col("word_idx").cast("int").alias("word_idx"), ((F.col("y0") + F.col("y1")) / 2).alias("mid"), F.max(height).over(Window.partitionBy("image_id")).cast("double").alias("high"))
    return in_order(rows, "image_id", [F.asc("word_idx"), F.asc("mid")], ["word_idx", "mid", "high"], lambda: _Lines(share), "word_idx int, line int")


class _Lines:
    def __init__(self, share: float):
        self.share, self.line, self.first = share, -1, 0.0

    def row(self, word: int, mid: float, high: float):
        if self.line < 0 or abs(mid - self.first) >= high * self.share:
            self.line, self.first = self.line + 1, mid
        yield word, self.line
