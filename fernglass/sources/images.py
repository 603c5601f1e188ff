"""Image files as pixel tables, and the tables in which recognized words and rendered pages land.

Decoding is Spark's image reader; recognition of text and rendering of PDF pages are external programs whose results are
tables: words (image_id, word_idx, text, confidence, x0, y0, x1, y1), and pages as image files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.operators import tiles as tiling

WORDS_SCHEMA = "image_id string, word_idx int, text string, confidence double, x0 int, y0 int, x1 int, y1 int"
PIXELS_SCHEMA = "image_id string, y int, x int, r int, g int, b int, a int"
ROWS = 1 << 16


def is_pdf(path: Column, mime: Column) -> Column:
    return (F.coalesce(mime, F.lit("")) == "application/pdf") | F.endswith(F.lower(path), F.lit(".pdf"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, width, height, channels, data): files that Spark decodes; others are left out. Bytes are B, G, R and maybe alpha, by rows."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return rows.select(F.col("origin").alias("image_id"), "width", "height", F.col("nChannels").alias("channels"), "data")


def pixels(decoded: DataFrame) -> DataFrame:
    """Pixel rows of decoded images, opaque where there is no alpha; gray images have equal channels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                image, w, h, c, data = (batch.column(k)[i].as_py() for k in range(5))
                flat = np.frombuffer(data, np.uint8).reshape(w * h, c).astype(np.int32)
                blue, green, red = (flat[:, min(k, c - 1) if c < 3 else k] for k in range(3))
                alpha = flat[:, 3] if c == 4 else np.full(w * h, 255, np.int32)
                for at in range(0, w * h, ROWS):
                    place = np.arange(at, min(w * h, at + ROWS), dtype=np.int32)
                    part = slice(at, at + len(place))
                    yield pa.RecordBatch.from_arrays([pa.array([image] * len(place)), pa.array(place // w), pa.array(place % w), *(pa.array(np.ascontiguousarray(v[part])) for v in (red, green, blue, alpha))], ["image_id", "y", "x", "r", "g", "b", "a"])

    return decoded.mapInArrow(run, PIXELS_SCHEMA)


def tiles(decoded: DataFrame, side: int = tiling.SIDE) -> DataFrame:
    """Decoded images as tiles (operators/tiles), opaque where there is no alpha; gray images have equal channels. No pixel becomes a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                w, h, c = (batch.column(k)[i].as_py() for k in range(1, 4))
                flat = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint8).reshape(h, w, c)
                for top in range(0, h, side):  # a strip of tiles at a time
                    strip = flat[top : top + side]
                    blue, green, red = (strip[:, :, min(k, c - 1) if c < 3 else k] for k in range(3))
                    planes = np.stack([red, green, blue, strip[:, :, 3] if c == 4 else np.full(strip.shape[:2], 255, np.uint8)])
                    yield tiling.batch_of(batch.column(0)[i], list(tiling.cut(planes, side, top, h)))

    return decoded.select("image_id", "width", "height", "channels", "data").mapInArrow(run, f"image_id string, {tiling.FIELDS}")


def kept(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The tiles stored in a folder; made and stored there first where it holds none, so that files are decoded once however many scans follow."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def pages(files: DataFrame, count: str = "n_pages") -> DataFrame:
    """A row for each page of a document, numbered from 1."""
    return files.withColumn("page", F.explode(F.sequence(F.lit(1), F.col(count))))


def cropped(pixels: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """A part of each image, its corner at 0, 0."""
    inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    return pixels.where(inside).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def thumbnails(pixels: DataFrame, most: int = 120) -> DataFrame:
    """Images no wider or higher than `most` pixels: each pixel the rounded mean of those that fall on it."""
    size = pixels.groupBy("image_id").agg(F.least(most / (F.max("x") + 1), most / (F.max("y") + 1)).alias("ratio"))
    small = lambda c: F.floor(F.col(c) * F.least(F.lit(1.0), F.col("ratio"))).cast("int").alias(c)
    rows = pixels.join(size, "image_id").select("image_id", small("y"), small("x"), "r", "g", "b", "a")
    return rows.groupBy("image_id", "y", "x").agg(*(F.floor(F.avg(c) + 0.5).cast("int").alias(c) for c in "rgba"))
