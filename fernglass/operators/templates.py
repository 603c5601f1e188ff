"""Template matching by normalized cross-correlation, over arrays of gray values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAT, UNDECIDED, LEAST_PIXELS, THRESHOLD = 1e-4, 0.5, 16, 0.4


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _correlation(a: Column, b: Column, otherwise: float) -> Column:
    """NCC of arrays of one length, `otherwise` where one is flat."""
    n = F.nullif(F.size(a).cast("double"), F.lit(0.0))
    means = lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), (_sum(p["a"]) / n_(p)).alias("m"), (_sum(p["b"]) / n_(p)).alias("k"))
    n_ = lambda p: F.nullif(F.size(p["a"]).cast("double"), F.lit(0.0))
    sums = lambda p: F.struct(
        _sum(F.zip_with(p["a"], p["b"], lambda x, y: (x - p["m"]) * (y - p["k"]))).alias("over"),
        F.sqrt(_sum(F.transform(p["a"], lambda x: (x - p["m"]) * (x - p["m"]))) * _sum(F.transform(p["b"], lambda y: (y - p["k"]) * (y - p["k"])))).alias("under"),
    )
    score = lambda p: F.when(p["under"] >= FLAT, p["over"] / F.when(p["under"] >= FLAT, p["under"]))
    found = _let(F.struct(a.alias("a"), b.alias("b")), lambda p: _let(means(p), lambda q: _let(sums(q), score)))
    return F.coalesce(F.when(n.isNotNull(), found), F.lit(otherwise))


def ncc(a: Column, b: Column) -> Column:
    """Normalized cross-correlation of two arrays of doubles; 0 if their lengths differ or one is flat."""
    return F.when(F.size(a) == F.size(b), _correlation(a, b, 0.0)).otherwise(0.0)


def centred(gray: Column, width: Column, height: Column, w: Column, h: Column) -> Column:
    """The middle w x h part of a row-major array of width x height."""
    left, top = F.floor((width - w) / 2).cast("int"), F.floor((height - h) / 2).cast("int")
    rows = F.transform(F.sequence(F.lit(0), (h - 1).cast("int")), lambda i: F.slice(gray, ((top + i) * width + left + 1).cast("int"), w.cast("int")))
    return F.when(w * h > 0, F.flatten(rows))


def overlap_ncc(a: Column, aw: Column, ah: Column, b: Column, bw: Column, bh: Column) -> Column:
    """NCC of the middle parts that two arrays share; 0.5 below 16 pixels or if one is flat."""
    w, h = F.least(aw, bw), F.least(ah, bh)
    found = _correlation(centred(a, aw, ah, w, h), centred(b, bw, bh, w, h), UNDECIDED)
    return F.coalesce(F.when(w * h >= LEAST_PIXELS, found), F.lit(UNDECIDED))


def window_score(score: Column, has_template: Column, x0: Column, y0: Column, x1: Column, y1: Column, tw: Column, th: Column) -> Column:
    """1 without a template; 0.5 where less than 70 % of either of the template's sides lies inside the image; else the score."""
    inside = (x1 - x0 >= 0.7 * tw) & (y1 - y0 >= 0.7 * th)
    return F.when(~has_template, F.lit(1.0)).when(~inside, F.lit(UNDECIDED)).otherwise(score)


def tiles(pixels: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """(key, width, height, gray) of boxes (key, image_id, x0, y0, x1, y1; ends exclusive): row-major luminance in single precision.

    Each place of a box meets its one pixel by image, row and column, so an image's other pixels are not touched."""
    places = boxes.select(F.col(key), "image_id", "x0", "y0", "x1", "y1").where("x1 > x0 and y1 > y0")
    places = places.withColumn("y", F.explode(F.sequence(F.col("y0").cast("long"), F.col("y1").cast("long") - 1))).withColumn("x", F.explode(F.sequence(F.col("x0").cast("long"), F.col("x1").cast("long") - 1)))
    light = (0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")).cast("float").cast("double")
    rows = places.join(pixels.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), light.alias("v")), ["image_id", "y", "x"])
    gray = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda p: p["v"])
    return rows.groupBy(key).agg((F.max("x1") - F.max("x0")).alias("width"), (F.max("y1") - F.max("y0")).alias("height"), gray.alias("gray"))


def window(rows: DataFrame, cx: Column, cy: Column, tw: Column, th: Column, width: str = "width", height: str = "height") -> DataFrame:
    """Rows with the box (x0, y0, x1, y1) of tw x th around (cx, cy): its corner is moved into the image, its ends are cut at the image's."""
    corner = rows.withColumns({"x0": F.greatest(F.lit(0), cx - F.floor(tw / 2)), "y0": F.greatest(F.lit(0), cy - F.floor(th / 2))})
    return corner.withColumns({"x1": F.least(F.col(width), F.col("x0") + tw), "y1": F.least(F.col(height), F.col("y0") + th)})


def capture_boxes(points: DataFrame, sizes: DataFrame, side: int = 32) -> DataFrame:
    """Boxes of the templates that are captured around points (image_id, px, py)."""
    return window(points.join(sizes, "image_id"), F.floor("px"), F.floor("py"), F.lit(side), F.lit(side)).drop("width", "height")


def swatch_boxes(swatches: DataFrame, least: int = 8) -> DataFrame:
    """Boxes of swatch templates; those less than 8 wide or high have none."""
    rows = swatches.withColumns({"x0": F.col("min_x"), "y0": F.col("min_y"), "x1": F.col("max_x"), "y1": F.col("max_y")})
    return rows.where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))


def row_boxes(bands: DataFrame, sizes: DataFrame, most: int = 32, least: int = 8) -> DataFrame:
    """Boxes of the templates of row bands (image_id, y_start, y_end): squares in the middle of the left quarter, at most 32 wide and as high as
    the band; none below 8."""
    rows = bands.join(sizes, "image_id").withColumn("quarter_", F.floor(F.col("width") * 0.25))
    rows = rows.withColumn("side_", F.least(F.lit(most), F.col("y_end") - F.col("y_start"), F.col("quarter_"))).where(F.col("side_") >= least)
    boxes = window(rows, F.floor(F.col("quarter_") / 2), F.floor((F.col("y_start") + F.col("y_end")) / 2), F.col("side_"), F.col("side_"))
    return boxes.where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least)).drop("width", "height", "quarter_", "side_")


#: Values of all templates together that are sent to every task.
MOST_VALUES = 4_000_000


def scored(blobs: DataFrame, pixels: DataFrame, templates: DataFrame, sizes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Blobs (image_id, color_id, blob_id, x, y, ...) whose window is like their colour's template (color_id, width, height, gray), with
    pattern_score: the NCC where the window has the template's size, that of the middle parts where it has not.

    Blobs of a colour without a template score 1 and stay."""
    if (templates.agg(F.sum(F.size("gray"))).first()[0] or 0) > MOST_VALUES:
        raise ValueError(f"templates have at most {MOST_VALUES} values together")
    t = F.broadcast(templates.select("color_id", F.col("width").alias("tw"), F.col("height").alias("th"), F.col("gray").alias("tg")))
    half_up = lambda c: F.floor(F.col(c) + 0.5)
    rows = blobs.join(sizes.select("image_id", "width", "height"), "image_id").join(t, "color_id", "left").withColumn("id_", F.struct("image_id", "color_id", "blob_id"))
    rows = window(rows, half_up("x"), half_up("y"), F.col("tw"), F.col("th")).drop("width", "height")
    near = (F.col("x1") - F.col("x0") >= 0.7 * F.col("tw")) & (F.col("y1") - F.col("y0") >= 0.7 * F.col("th"))
    cut = tiles(pixels, rows.where(near).select("id_", "image_id", "x0", "y0", "x1", "y1"), "id_").select("id_", F.col("width").alias("cw"), F.col("height").alias("ch"), "gray")
    both = rows.join(cut, "id_", "left")
    same = (F.col("cw") == F.col("tw")) & (F.col("ch") == F.col("th"))
    score = F.when(same, ncc(F.col("tg"), F.col("gray"))).otherwise(overlap_ncc(F.col("tg"), F.col("tw"), F.col("th"), F.col("gray"), F.col("cw"), F.col("ch")))
    final = window_score(score, F.col("tg").isNotNull(), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("tw"), F.col("th"))
    return both.withColumn("pattern_score", final).where(F.col("tg").isNull() | (F.col("pattern_score") >= threshold)).select(*[c for c in blobs.columns if c != "pattern_score"], "pattern_score")
