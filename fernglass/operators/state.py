"""The small relational work around an image: lookups, keyed upserts, cascades, listings, feedback, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def default(column: Column, value: Column) -> Column:
    """The value where a text is null or empty."""
    return F.coalesce(F.nullif(column, F.lit("")), value)


def left_lookup(rows: DataFrame, dim: DataFrame, key: str, dim_key: str, order: str, fold: bool = False) -> DataFrame:
    """rows with the first dim row (by `order`) of their key, letters' case left aside on demand."""
    name = (lambda c: F.lower(c)) if fold else (lambda c: c)
    first = dim.withColumn("__key", name(F.col(dim_key))).withColumn("__nth", F.row_number().over(Window.partitionBy("__key").orderBy(order))).where("__nth = 1").drop("__nth")
    return rows.join(first, name(F.col(key)) == F.col("__key"), "left").drop("__key")


def unlisted(names: DataFrame, listed: DataFrame, name: str = "name") -> DataFrame:
    """Listed names as they are, then those of `names` that are not among them (case aside)."""
    low = listed.select(F.lower(name).alias("__low")).distinct()
    rest = names.join(low, F.lower(names[name]) == F.col("__low"), "left_anti")
    return listed.select(name, F.lit("listed").alias("origin")).unionByName(rest.select(name, F.lit("rest").alias("origin")))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def latest(rows: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """The last row of each key."""
    by = Window.partitionBy(key).orderBy(F.col(order).desc(), F.col(tie).desc())
    return rows.withColumn("__nth", F.row_number().over(by)).where("__nth = 1").drop("__nth")


def upserted(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new rows, and the stored ones of other keys."""
    return without(stored, new, key).unionByName(new)


def next_id(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.agg((F.coalesce(F.max(key), F.lit(0)) + 1).cast("long").alias("next_id"))


def hits_per_colour(palette: DataFrame, blobs: DataFrame) -> DataFrame:
    """The palette with `hits`, 0 where a colour was not found, and found/missing."""
    n = blobs.groupBy(F.col("color_id").alias("id")).agg(F.count("*").alias("hits"))
    rows = palette.join(n, "id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return rows.withColumn("part", F.when(F.col("hits") > 0, "found").otherwise("missing"))


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """Counts of correct, close, wrong, duplicate and missing."""
    kinds = [F.count_if(F.col("rating") == r).alias(r) for r in ("correct", "close", "wrong", "duplicate")]
    return feedback.agg(*kinds, F.count_if(F.coalesce("is_missing", F.lit(False))).alias("missing"))


def recent(saved: DataFrame) -> DataFrame:
    """Saved images with the numbers of their annotations and markers, newest first."""
    count = lambda c: F.size(F.coalesce(F.col(c), F.array().cast(saved.schema[c].dataType)))
    return saved.select("id", "name", "saved_at", count("annotations").alias("n_annotations"), count("markers").alias("n_markers")).orderBy(F.col("saved_at").desc(), "id")


def confirmed(entries: DataFrame) -> DataFrame:
    """Legend entries with a name and a colour, numbered from 1 in order, with no hits yet."""
    kept = entries.where((F.coalesce("name", F.lit("")) != "") & F.col("cr").isNotNull())
    return kept.withColumn("id", F.row_number().over(Window.partitionBy("image_id").orderBy("ord"))).withColumn("count", F.lit(0))


def legend_palette(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A confirmed legend takes the place of palette and markers: the new palette (image_id, id, name, db_key, cr, cg, cb, count) and the images whose
    markers go."""
    palette = confirmed(entries).select("image_id", "id", "name", F.lower("name").alias("db_key"), "cr", "cg", "cb", "count")
    return palette, entries.select("image_id").distinct()


def low_confidence(confidence: Column, least: int = 60) -> Column:
    return confidence < least


def visible(kind: Column, annotating: Column) -> Column:
    """While annotating only annotations show, else both kinds."""
    return (kind == "annotation") | ~annotating


def display_colour(own: Column, palette: Column) -> Column:
    """rgb(...) of a marker's own colour, else its palette entry's; null for lists of fewer than three numbers."""
    colour = F.coalesce(own, palette)
    return F.when(F.size(colour) >= 3, F.concat(F.lit("rgb("), F.concat_ws(",", F.slice(colour, 1, 3)), F.lit(")")))


def with_feedback(markers: DataFrame, feedback: DataFrame, key: str = "marker_id", order: str = "timestamp", tie: str = "rating") -> DataFrame:
    """Markers with the rating and the correct name of their latest feedback, and the class that shows it."""
    last = latest(feedback, key, order, tie).select(F.col(key).alias("__key"), "rating", "correct_name")
    rows = markers.join(last, F.col(key) == F.col("__key"), "left").drop("__key")
    return rows.withColumn("shown_as", F.concat(F.lit("debug-"), "rating"))


def iso_time(at: Column) -> Column:
    """A time in UTC as browsers write it: 2024-01-31T09:05:00.000Z."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def shown_time(at: Column) -> Column:
    """A saved image's time in the session's zone, as it is shown: 1/31/2024 09:05 AM."""
    return F.date_format(at, "M/d/yyyy hh:mm a")


def export_json(filename: Column, tolerance: Column, date: Column, palette: Column, feedback: Column, totals: Column, summary: Column) -> Column:
    """One pretty-printed JSON document of a scan and its feedback. palette: array<struct<id,name,color,count>>."""
    legend = F.transform(palette, lambda p: F.struct(p["id"].alias("id"), p["name"].alias("name"), p["color"].alias("color"), F.coalesce(p["count"], F.lit(0)).alias("count")))
    fields = {"exportDate": date, "imageFilename": filename, "colorTolerance": tolerance, "legendEntries": legend, "totalMarkers": totals["markers"], "feedbackCount": totals["feedback"], "feedback": feedback, "summary": summary}
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())), {"pretty": "true"})


FEEDBACK_FIELDS = ("markerId", "timestamp", "rating", "detectedName", "detectedColor", "position", "correctName", "notes", "isMissing")


def export_lines(head: DataFrame, feedback: DataFrame) -> DataFrame:
    """(part, marker_id, line): the whole export as lines, which in the order of these two columns are one JSON document.

    head: one row of filename, tolerance, date, legend (array<struct<id,name,color,count>>), markers, feedback_count and summary. feedback: rows of
    FEEDBACK_FIELDS, one a marker; they stand in the document's list by markerId, each on a line of its own, so that the list may be of any length."""
    entries = F.transform("legend", lambda p: F.struct(p["id"].alias("id"), p["name"].alias("name"), p["color"].alias("color"), F.coalesce(p["count"], F.lit(0)).alias("count")))
    fields = {"exportDate": F.col("date"), "imageFilename": F.col("filename"), "colorTolerance": F.col("tolerance"), "legendEntries": entries, "totalMarkers": F.col("markers"), "feedbackCount": F.col("feedback_count")}
    first = F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))
    none = F.lit(None).cast("string").alias("marker_id")
    above = head.withColumn("open_", first).select(F.lit(0).alias("part"), none, F.concat(F.expr("left(open_, char_length(open_) - 1)"), F.lit(',"feedback":[')).alias("line"))
    below = head.select(F.lit(2).alias("part"), none, F.concat(F.lit('],"summary":'), F.to_json("summary"), F.lit("}")).alias("line"))
    least = feedback.agg(F.min("markerId").alias("first_"))
    rows = feedback.join(F.broadcast(least)).select(F.lit(1).alias("part"), F.col("markerId").alias("marker_id"), F.concat(F.when(F.col("markerId") == F.col("first_"), "").otherwise(","), F.to_json(F.struct(*FEEDBACK_FIELDS), {"ignoreNullFields": "false"})).alias("line"))
    return above.unionByName(rows).unionByName(below)


def imported_lines(texts: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """(key, pos, line) of pasted texts: lines without white space at their ends, empty ones dropped."""
    from fernglass.functions.text import trimmed

    rows = texts.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    return rows.select(key, "pos", trimmed(F.col("line")).alias("line")).where("line != ''")
