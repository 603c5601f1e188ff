
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernglass.operators import components
from fernglass.operators import tiles as tiling

SIDE = 64
PALETTE = ((1, "middle gray", 128, 128, 128), (2, "rust", 160, 128, 96), (3, "slate", 96, 128, 160))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a scan below which its rows may all be in one row group, hence in one task.
SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small scan's rows dealt to all cores, as a file with one row group is read by one task; a larger scan as it is."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if int(size) < SMALL else df


def dealt(spark: SparkSession) -> int:
    """Into how many tasks rows go that make rasters: all cores four times, or the session's shuffle partitions if these are more."""
    return components.tasks(spark)


def palette(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PALETTE, "id int, name string, r int, g int, b int")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster for each label of `embeddings`: vectors are rows, positions columns; channels come from three shifted positions."""
    row = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("image_id"), row.cast("long").alias("y"), "embedding")
    cells = rows.select("image_id", "y", "embedding", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias("x"))
    level = lambda shift: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + F.get("embedding", (F.col("x") + shift) % SIDE).cast("double") * 400))).cast("int")
    return cells.select("image_id", "y", F.col("x").cast("long").alias("x"), level(0).alias("r"), level(21).alias("g"), level(42).alias("b"), F.lit(255).alias("a"))


def tiles(spark: SparkSession, sf_dir: str, side: int = SIDE) -> DataFrame:
    """The same rasters as tiles."""
    rows = Window.partitionBy("label")
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("image_id"), (F.row_number().over(rows.orderBy("vec_id")) - 1).alias("y"), F.count("*").over(rows).cast("int").alias("height"), F.col("embedding").cast("array<double>").alias("v"))

    def strip(found: pa.Table) -> pa.Table:
        found = found.sort_by("y")
        v = np.floor(128 + np.array(found["v"].to_pylist()) * 400).clip(0, 255).astype(np.uint8)
        planes = np.stack([np.roll(v, -shift, 1) for shift in (0, 21, 42)] + [np.full(v.shape, 255, np.uint8)])
        return pa.Table.from_batches([tiling.batch_of(found["image_id"][0], list(tiling.cut(planes, side, found["y"][0].as_py(), found["height"][0].as_py())))])

    return e.withColumn("strip", F.floor(F.col("y") / side)).groupBy("image_id", "strip").applyInArrow(strip, f"image_id long, {tiling.FIELDS}")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, line) of documents' texts."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


PIXELS_SQL = """
raw AS (
  SELECT label::BIGINT AS image_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::BIGINT AS y, embedding FROM embeddings
), cells AS (SELECT image_id, y, embedding, unnest(range(64))::BIGINT AS x FROM raw
), pixels AS (
  SELECT image_id, y, x, 255 AS a,
    least(255, greatest(0, floor(128 + embedding[x + 1]::DOUBLE * 400)))::BIGINT AS r,
    least(255, greatest(0, floor(128 + embedding[(x + 21) % 64 + 1]::DOUBLE * 400)))::BIGINT AS g,
    least(255, greatest(0, floor(128 + embedding[(x + 42) % 64 + 1]::DOUBLE * 400)))::BIGINT AS b
  FROM cells
), palette AS (SELECT * FROM (VALUES (1, 'middle gray', 128, 128, 128), (2, 'rust', 160, 128, 96), (3, 'slate', 96, 128, 160)) AS t(id, name, pr, pg, pb))
"""
LINES_SQL = "lines AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"
