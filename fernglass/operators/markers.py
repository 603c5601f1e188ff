"""Markers and annotations: created from hits and points, edited, rescanned, rated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernglass.functions import text as rules
from fernglass.functions import viewport
from fernglass.operators import raster, resolve, state
from fernglass.operators.components import numbered

ATTRIBUTES = ("common", "botanical", "type", "size", "bloom", "sun", "water", "notes")

# Headings of plant types.
TYPE_LABELS = {
    "deciduous-tree": "Deciduous Trees", "evergreen-tree": "Evergreen Trees", "deciduous-shrub": "Deciduous Shrubs", "evergreen-shrub": "Evergreen Shrubs",
    "perennial": "Perennials", "perennial-bulb": "Perennial Bulbs", "annual": "Annuals", "ornamental-grass": "Ornamental Grasses", "ground-cover": "Ground Covers",
    "vine": "Vines", "succulent": "Succulents", "fern": "Ferns", "": "Uncategorized",
}


def type_label(kind: Column) -> Column:
    """The heading of a type; null and '' are uncategorized, unknown types null."""
    pairs = [F.lit(v) for pair in TYPE_LABELS.items() for v in pair]
    return F.try_element_at(F.create_map(*pairs), F.coalesce(kind, F.lit("")))


def image_points(clicks: DataFrame) -> DataFrame:
    """Clicks (client_x, client_y, corner_x, corner_y, offset_x, offset_y, scale) with x and y in the image."""
    at = lambda d: viewport.to_image(F.col(f"client_{d}"), F.col(f"corner_{d}"), F.col(f"offset_{d}"), F.col("scale"))
    return clicks.withColumns({"x": at("x"), "y": at("y")})


def annotated(points: DataFrame, palette: DataFrame, plants: DataFrame, genera: DataFrame, after: int = 0) -> DataFrame:
    """Annotations of named points (point_id, x, y, name): blank names are left out; ids go on from `after`; a palette colour of the
    same name (case aside, the lowest id) is linked; attributes come from the dictionaries."""
    rows = points.withColumn("name", rules.trimmed(F.col("name"))).where("name != ''")
    linked = state.left_lookup(rows, palette.select(F.col("id").alias("color_id"), F.col("name").alias("__palette_name")), "name", "__palette_name", "color_id", fold=True).drop("__palette_name")
    full = resolve.enriched(numbered(linked, ("point_id",), "id", after + 1), plants, genera).drop("stage")
    return full.withColumns({"photos": F.array().cast("array<string>"), "photos_fetched": F.lit(False)})


def rescanned(markers: DataFrame, blobs: DataFrame, palette: DataFrame) -> DataFrame:
    """Markers (color_id, image_id, x, y, blob_size, name) after colours were scanned again: those of scanned colours give way to the new hits."""
    fresh = blobs.join(palette.select(F.col("id").alias("color_id"), "name"), "color_id").select("color_id", "image_id", "x", "y", F.col("size").alias("blob_size"), "name")
    return state.without(markers, palette.select(F.col("id").alias("color_id")), "color_id").select(*fresh.columns).unionByName(fresh)


def scanned(markers: DataFrame, pixels: DataFrame, palette: DataFrame, plants: DataFrame, genera: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """Colours (id, name, r, g, b) scanned again: the markers, in which their old ones have given way to new hits with attributes from the
    dictionaries, and the palette with its counts. New ids go on from the largest of all. `limits` are those of `raster.scan`."""
    blobs = raster.scan(pixels, palette, **limits)
    counts = state.hits_per_colour(palette, blobs).withColumnRenamed("hits", "count").drop("part")
    first = state.next_id(markers).first()[0]
    fresh = numbered(blobs.join(palette.select(F.col("id").alias("color_id"), "name"), "color_id"), ("color_id", "image_id", "blob_id"), "id", first)
    full = resolve.enriched(fresh.select("id", "image_id", "x", "y", F.col("size").alias("blob_size"), "color_id", F.array("cr", "cg", "cb").alias("found_colour"), "name"), plants, genera).drop("stage")
    full = full.withColumns({"photos": F.array().cast("array<string>"), "photos_fetched": F.lit(False)})
    return state.without(markers, palette.select(F.col("id").alias("color_id")), "color_id").unionByName(full, allowMissingColumns=True), counts


def edited(records: DataFrame, edits: DataFrame, key: str = "id") -> DataFrame:
    """Records with the attributes of their edits (one a key); an edit also drops the photos."""
    new = edits.select(F.col(key).alias("__key"), *(F.col(a).alias(f"__new_{a}") for a in ATTRIBUTES), F.lit(True).alias("__hit"))
    rows = records.join(new, F.col(key) == F.col("__key"), "left")
    hit = F.coalesce("__hit", F.lit(False))
    values = {a: F.when(hit, F.col(f"__new_{a}")).otherwise(F.col(a)) for a in ATTRIBUTES}
    values |= {"photos": F.when(hit, F.array().cast(records.schema["photos"].dataType)).otherwise(F.col("photos")), "photos_fetched": F.when(hit, False).otherwise(F.col("photos_fetched"))}
    return rows.withColumns(values).select(*records.columns)


def missing_stub(clicks: DataFrame) -> DataFrame:
    """(marker_id, position, is_missing) for clicks where a plant was not found; `at_ms` makes the id."""
    whole = lambda c: F.floor(F.col(c) + 0.5).cast("int").alias(c)
    return image_points(clicks).select(F.concat(F.lit("missing_"), F.col("at_ms").cast("string")).alias("marker_id"), F.struct(whole("x"), whole("y")).alias("position"), F.lit(True).alias("is_missing"))
