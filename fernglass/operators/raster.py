"""Pixel tables: masks, regions with statistics, proximity merging and shape filters.

A pixel row is (image_id, y, x, r, g, b, a). A palette row is (id, name, r, g, b); all colours of a palette are looked for in one pass
over the pixels, and every region carries the id of its colour, so one image's work is spread by (image, colour).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernglass.functions import colour
from fernglass.operators import templates as patterns
from fernglass.operators.components import components, dealt, pixel_components

TOLERANCE, LEAST_SIZE, LEAST_RADIUS, MOST_ASPECT = 40, 30, 30, 8


def colour_mask(pixels: DataFrame, palette: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Pixels that match a palette colour, with its `color_id`. The palette must be small: it is checked to be at most 10,000 rows."""
    if palette.limit(10_001).count() > 10_000:
        raise ValueError("a palette has at most 10,000 colours")
    p = F.broadcast(palette.select(F.col("id").alias("color_id"), F.col("r").alias("__pr"), F.col("g").alias("__pg"), F.col("b").alias("__pb")))
    near = colour.matches(F.col("r"), F.col("g"), F.col("b"), F.col("a"), (F.col("__pr"), F.col("__pg"), F.col("__pb")), tolerance)
    return pixels.join(p, near).drop("__pr", "__pg", "__pb")


def match_counts(pixels: DataFrame, palette: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """(image_id, color_id, matches) of the colours that an image shows."""
    return colour_mask(pixels, palette, tolerance).groupBy("image_id", "color_id").agg(F.count("*").alias("matches"))


def highlighted(pixels: DataFrame, target: tuple[int, int, int], tolerance: int = TOLERANCE, paint: tuple[int, int, int, int] = (255, 255, 0, 140)) -> DataFrame:
    """An overlay: `paint` where a pixel matches, clear elsewhere."""
    hit = colour.matches(F.col("r"), F.col("g"), F.col("b"), F.col("a"), target, tolerance)
    return pixels.select("image_id", "y", "x", *(F.when(hit, F.lit(v)).otherwise(0).alias(c) for c, v in zip("rgba", paint, strict=True)))


def regions(mask: DataFrame, least: int = LEAST_SIZE) -> DataFrame:
    """8-connected regions of a mask with r, g, b, for each (image_id, color_id), from `least` pixels on.

    Columns: blob_id (least y * 2**24 + x of its first run), x, y (means), size, cr, cg, cb (rounded means), min_x, max_x, min_y, max_y."""
    found = pixel_components(mask.select("image_id", "color_id", "y", "x", "r", "g", "b"), ("image_id", "color_id"), ("r", "g", "b")).groupBy("image_id", "color_id", "root").agg(
        F.sum("n").alias("size"), F.sum("sx").alias("sx"), F.sum(F.col("y") * F.col("n")).alias("sy"), *(F.sum(f"s{c}").alias(f"s{c}") for c in "rgb"),
        F.min("x0").alias("min_x"), F.max("x1").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"),
    ).where(F.col("size") >= least)
    return found.select(
        "image_id", "color_id", F.col("root").alias("blob_id"), (F.col("sx") / F.col("size")).alias("x"), (F.col("sy") / F.col("size")).alias("y"), "size",
        *(colour.rounded(F.col(f"s{c}") / F.col("size")).alias(f"c{c}") for c in "rgb"), "min_x", "max_x", "min_y", "max_y",
    )


def near_edges(blobs: DataFrame, floor: float = LEAST_RADIUS) -> DataFrame:
    """(image_id, a, b) of blobs of one (image, colour) whose boxes meet when one is grown by the larger radius of the two.

    A blob's radius is max(floor, half its longer side). A blob grown by its own radius is looked up in cells about as wide as itself
    (powers of two), by the blobs of its size class or a smaller one, so a large region does not make all pairs of small ones."""
    key = F.struct("image_id", "color_id")
    side = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    rows = blobs.select(key.alias("image_id"), F.col("blob_id").alias("id"), "min_x", "max_x", "min_y", "max_y", F.greatest(F.lit(float(floor)), side * 0.5).alias("radius"))
    level = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("radius")))).cast("int")  # 2 ** level >= radius: the larger of two has the larger level
    rows = rows.withColumn("level", level)
    classes = rows.select("image_id", F.col("level").alias("at")).distinct()

    def cells(df, reach, at):
        cell = F.pow(F.lit(2.0), F.col(at))
        low, high = lambda c: F.floor((F.col(c) - reach) / cell), lambda c: F.floor((F.col(c) + reach) / cell)
        return df.withColumn("cx", F.explode(F.sequence(low("min_x"), high("max_x")))).withColumn("cy", F.explode(F.sequence(low("min_y"), high("max_y"))))

    # The blob with the larger level goes into the cells of its own level, grown; the other one into those of every larger level of its image.
    a = cells(rows.withColumn("at", F.col("level")), F.col("radius"), "at").alias("a")
    b = cells(rows.join(classes, "image_id").where("at >= level"), F.lit(0), "at").alias("b")
    pad = F.greatest(F.col("a.radius"), F.col("b.radius"))
    touch = (F.col("a.min_x") - pad <= F.col("b.max_x")) & (F.col("a.max_x") + pad >= F.col("b.min_x")) & (F.col("a.min_y") - pad <= F.col("b.max_y")) & (F.col("a.max_y") + pad >= F.col("b.min_y"))
    same = (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.at") == F.col("b.at")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.id") != F.col("b.id"))
    found = a.join(dealt(b), same & touch).where((F.col("b.level") < F.col("a.level")) | (F.col("b.radius") <= F.col("a.radius")))
    return found.select(F.col("a.image_id").alias("image_id"), F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()


def merged(blobs: DataFrame, floor: float = LEAST_RADIUS) -> DataFrame:
    """Blobs joined with all they reach through near ones: sizes added, centres and (rounded) colours weighted by size, boxes united."""
    rows = blobs.withColumn("key", F.struct("image_id", "color_id"))
    roots = components(rows.select(F.col("key").alias("image_id"), F.col("blob_id").alias("id")), near_edges(blobs, floor)).select(F.col("image_id").alias("key"), F.col("id").alias("blob_id"), "root")
    weighted = lambda c: F.sum(F.col(c) * F.col("size"))
    found = rows.join(dealt(roots), ["key", "blob_id"]).groupBy("key", "root").agg(
        weighted("x").alias("wx"), weighted("y").alias("wy"), *(weighted(f"c{c}").alias(f"w{c}") for c in "rgb"), F.sum("size").alias("size"), F.count("*").alias("parts"),
        F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"), F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"),
    )
    return found.select(
        "key.image_id", "key.color_id", F.col("root").alias("blob_id"), (F.col("wx") / F.col("size")).alias("x"), (F.col("wy") / F.col("size")).alias("y"), "size",
        *(colour.rounded(F.col(f"w{c}") / F.col("size")).alias(f"c{c}") for c in "rgb"), "min_x", "max_x", "min_y", "max_y", "parts",
    )


def compact(blobs: DataFrame, most: float = MOST_ASPECT) -> DataFrame:
    """Blobs whose longer side (max - min) is less than `most` times the shorter one (at least 1)."""
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    return blobs.where(F.greatest(w, h) / F.greatest(F.lit(1), F.least(w, h)) < most)


def image_sizes(pixels: DataFrame) -> DataFrame:
    """(image_id, width, height)."""
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def scan(pixels: DataFrame, palette: DataFrame, tolerance: int = TOLERANCE, least: int = LEAST_SIZE, floor: float = LEAST_RADIUS, templates: DataFrame | None = None, threshold: float = patterns.THRESHOLD) -> DataFrame:
    """The whole search: mask, regions, merging, shape, and the pattern where a colour has a template (color_id, width, height, gray).

    Blobs without a template have pattern_score 1."""
    found = compact(merged(regions(colour_mask(pixels, palette, tolerance), least), floor))
    if templates is None:
        return found.withColumn("pattern_score", F.lit(1.0))
    return patterns.scored(found, pixels, templates, image_sizes(pixels), threshold)


def row_density(pixels: DataFrame) -> DataFrame:
    """(image_id, y, density): the share of a row's pixels that are neither paper nor ink-black."""
    return pixels.groupBy("image_id", "y").agg((F.count_if(colour.inked(F.col("r"), F.col("g"), F.col("b"))) / F.count("*")).alias("density"))


def row_bands(density: DataFrame, threshold: float = 0.05, least: int = 4, gap: int = 3) -> DataFrame:
    """(image_id, y_start, y_end) of runs of dense rows at least `least` high, those less than `gap` apart joined.

    A run ends at the first row that is not dense; one that reaches the last row ends there."""
    by_row = Window.partitionBy("image_id").orderBy("y")
    rows = density.withColumn("last", F.max("y").over(Window.partitionBy("image_id"))).where(F.col("density") >= threshold)
    rows = rows.withColumn("g", F.col("y") - F.row_number().over(by_row)).groupBy("image_id", "g").agg(F.min("y").alias("y_start"), F.least(F.max("y") + 1, F.max("last")).alias("y_end"))
    rows = rows.where(F.col("y_end") - F.col("y_start") >= least)
    by_start = Window.partitionBy("image_id").orderBy("y_start")
    fresh = F.coalesce((F.col("y_start") - F.lag("y_end").over(by_start) >= gap).cast("int"), F.lit(1))
    joined = rows.withColumn("fresh", fresh).withColumn("band", F.sum("fresh").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy("image_id", "band").agg(F.min("y_start").alias("y_start"), F.max("y_end").alias("y_end")).drop("band")


def mean_colours(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg(F.count("*").alias("n"), *(colour.rounded(F.avg(c)).alias(f"c{c}") for c in "rgb"))


def sampled_colour(pixels: DataFrame, points: DataFrame, radius: int = 3) -> DataFrame:
    """(point_id, cr, cg, cb): the rounded mean around points (point_id, image_id, px, py), paper and line left out; else the
    point's own pixel. The window is 2 * radius + 1 wide from its corner, which is kept inside the image."""
    left, top, wide = F.greatest(F.lit(0), F.col("px") - radius), F.greatest(F.lit(0), F.col("py") - radius), F.lit(2 * radius)
    places = points.withColumn("y", F.explode(F.sequence(top.cast("long"), (top + wide).cast("long")))).withColumn("x", F.explode(F.sequence(left.cast("long"), (left + wide).cast("long"))))
    rows = places.join(pixels, ["image_id", "y", "x"])
    out = colour.extreme(F.col("r"), F.col("g"), F.col("b"))
    own = (F.col("x") == F.col("px")) & (F.col("y") == F.col("py"))
    return rows.groupBy("point_id").agg(*(F.coalesce(colour.rounded(F.avg(F.when(~out, F.col(c)))), F.max(F.when(own, F.col(c))).cast("long")).alias(f"c{c}") for c in "rgb"))


def band_colours(pixels: DataFrame, bands: DataFrame, share: float = 0.35, least: int = 5) -> DataFrame:
    """(image_id, y_start, y_end, cr, cg, cb): the mean of each band's swatch pixels, null with fewer than `least`.

    Swatches stand in the left `share` of a row; pixels brighter than 225 or darker than 30 are paper or ink."""
    width = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"))
    shade = colour.brightness(F.col("r"), F.col("g"), F.col("b"))
    swatch = pixels.where((shade <= 225) & (shade >= 30)).join(width, "image_id").where(F.col("x") < F.floor(F.col("w") * share)).select("image_id", "y", "r", "g", "b")
    sums = swatch.groupBy("image_id", "y").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{c}") for c in "rgb"))  # rows of pixels first: bands are made of them
    return colours_of_bands(bands, sums, least)


def colours_of_bands(bands: DataFrame, sums: DataFrame, least: int = 5) -> DataFrame:
    """The colours of bands from sums over their rows' swatch pixels (image_id, y, n, sr, sg, sb)."""
    rows = bands.withColumn("y", F.explode(F.sequence(F.col("y_start").cast("long"), F.col("y_end").cast("long")))).join(dealt(sums), ["image_id", "y"], "left")
    return rows.groupBy("image_id", "y_start", "y_end").agg(*(F.when(F.sum("n") >= least, colour.rounded(F.sum(f"s{c}") / F.sum("n"))).alias(f"c{c}") for c in "rgb"))
