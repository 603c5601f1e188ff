"""A legend from its image and recognized words: by swatches, or by rows where an image has none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.functions import text as rules
from fernglass.functions.colour import rounded
from fernglass.operators import layout, raster, swatches, templates, tiles
from fernglass.operators.components import checkpointed, dealt, tasks

BOX = ("min_x", "max_x", "min_y", "max_y")


#: Images up to which the ids of those with swatches are sent to all tasks.
MOST_SENT = 100_000


def row_entries(sums: DataFrame, bands: DataFrame, words: DataFrame) -> DataFrame:
    """(image_id, ord, name, confidence, cr, cg, cb, y_start, y_end) of row bands that have a colour and a name of two characters or more; sums as from `tiles.row_sums`.

    Words of a band stand right of a quarter of the image's width with their middle inside the band. Bands without any keep name '' and confidence 0."""
    sizes = _sizes(sums)
    coloured = raster.colours_of_bands(bands, sums.where("n > 0").select("image_id", "y", "n", "sr", "sg", "sb")).where("cr is not null")
    found = words.join(sizes.select("image_id", "width"), "image_id").where(F.col("x0") >= F.floor(F.col("width") * 0.25)).withColumn("mid", (F.col("y0") + F.col("y1")) / 2)
    spans = coloured.select("image_id", "y_start", "y_end", F.col("y_start").cast("double").alias("low"), F.col("y_end").cast("double").alias("high"))
    rows = layout.banded(spans, found.select("image_id", "x0", "word_idx", "text", "confidence", F.col("mid").alias("at")))
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("x0", "word_idx", "text")))), lambda v: v["text"]), " ")
    read = rows.groupBy("image_id", "y_start", "y_end").agg(raw.alias("raw"), rounded(F.avg("confidence")).alias("mean"))
    out = coloured.join(dealt(read), ["image_id", "y_start", "y_end"], "left").select("image_id", "y_start", "y_end", "cr", "cg", "cb", rules.clean(rules.trimmed(F.coalesce("raw", F.lit("")))).alias("name"), F.coalesce("mean", F.lit(0)).cast("long").alias("confidence"))
    return out.withColumn("ord", F.col("y_start").cast("long"))


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("image_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))


def without(drawn: DataFrame, images: DataFrame) -> DataFrame:
    """Tiles of other images. Up to MOST_SENT ids are sent to the tiles, which then stay where they are; more meet them in a shuffle."""
    images = images.select("image_id").distinct()
    few = images.limit(MOST_SENT + 1).count() <= MOST_SENT
    return drawn.join(F.broadcast(images) if few else images.hint("shuffle_hash"), "image_id", "left_anti")


def parse(drawn: DataFrame, words: DataFrame, failed: DataFrame | None = None, side: int = tiles.SIDE) -> DataFrame:
    """Entries (image_id, ord, name, confidence, cr, cg, cb, min_x, max_x, min_y, max_y, y_start, y_end, template) of legend images, given as tiles.

    Images with swatches are read swatch by swatch, the others row by row (then the box is null, else the band). `failed` lists images whose text
    could not be recognized: their swatches or coloured bands come with name '' and confidence 0. template: (width, height, gray), null if too small.

    Tiles, which may cost much to make, are gone through three times: for swatches, for the rows of images without any, and for templates."""
    found = checkpointed(swatches.detect(drawn, sized=True))
    sums = checkpointed(tiles.row_sums(without(drawn, found)))
    sizes = checkpointed(_sizes(found).unionByName(_sizes(sums)))
    bands = checkpointed(raster.row_bands(sums.select("image_id", "y", "density")))
    bad = failed.select("image_id").distinct() if failed is not None else sizes.select("image_id").limit(0)
    read = words.join(bad, "image_id", "left_anti")
    bounded = checkpointed(layout.right_boundaries(found.drop("width", "height"), sizes))
    whole = lambda *names: [F.col(c).cast("long").alias(c) for c in names]
    none = lambda *names: [F.lit(None).cast("long").alias(c) for c in names]
    colours, box, band = whole("cr", "cg", "cb"), whole(*BOX), whole("y_start", "y_end")
    one = layout.entries(bounded, read).select("image_id", F.col("ord").cast("long").alias("ord"), "name", F.col("confidence").cast("long").alias("confidence"), *colours, *box, *none("y_start", "y_end"))
    bare = bounded.join(bad, "image_id", "left_semi").select("image_id", F.col("ord").cast("long").alias("ord"), F.lit("").alias("name"), F.lit(0).cast("long").alias("confidence"), *colours, *box, *none("y_start", "y_end"))
    lined = row_entries(sums, bands, read)
    lined = lined.join(bad.withColumn("bad_", F.lit(True)), "image_id", "left").where(F.col("bad_") | (F.char_length("name") >= 2))
    two = lined.select("image_id", "ord", "name", "confidence", *colours, *none(*BOX), *band)
    entries = checkpointed(one.unionByName(bare).unionByName(two).repartition(tasks(drawn.sparkSession), "image_id", "ord"))
    key = F.struct("image_id", "ord").alias("key_")
    boxes = templates.swatch_boxes(entries.where("min_x is not null")).select(key, "image_id", "x0", "y0", "x1", "y1").unionByName(templates.row_boxes(entries.where("y_start is not null"), sizes).select(key, "image_id", "x0", "y0", "x1", "y1"))
    cut = tiles.captured(drawn, boxes, "key_", side).select("key_", F.struct("width", "height", "gray").alias("template"))
    number = tasks(drawn.sparkSession)
    return entries.withColumn("key_", key).repartition(number, "key_").join(dealt(cut.repartition(number, "key_")), "key_", "left").drop("key_")
