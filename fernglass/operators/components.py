"""Connected components: of pixels, by runs of rows, and of rows in an edge table.

Pixels' runs are joined inside strips of rows first. Labels that are left, as those of an edge table, spread the least label of a component until nothing changes. Each round is a join and an aggregation; what a round
made is written to the folder of spark.checkpoint.dir, which cuts the lineage. After each spreading step labels jump to
their label's label, so that the number of rounds grows with the logarithm of a component's diameter.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the folder that the session names; a new local one only where none is set and the master is local."""
    spark: SparkSession = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="fernglass-"))
    return df.checkpoint()


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of a join that meets the other one in a shuffle, never as a broadcast from the driver.

    Sizes that Spark goes by are those of what rows are made from (boxes, not the planes drawn of them) or of compressed shuffle files, a hundredth of what rows of equal values
    take in memory; so tables that grow with the input came to the driver whole."""
    return df.hint("merge")


def tasks(spark: SparkSession) -> int:
    """Into how many tasks rows go that Python works on, or that are far larger in memory than in shuffle files: all cores four times, or the session's shuffle
    partitions if these are more. Adaptive execution does not join tasks that a number was asked for; it goes by the files' bytes."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def components(nodes: DataFrame, edges: DataFrame, image: str = "image_id") -> DataFrame:
    """(image, id, root) for nodes (image, id) and edges (image, a, b) in either or both directions; root is the least id."""
    both = checkpointed(edges.select(image, "a", "b").unionByName(edges.select(image, F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    now = checkpointed(nodes.select(image, "id", F.col("id").alias("root")))
    while True:
        seen = both.join(dealt(now.select(image, F.col("id").alias("b"), F.col("root").alias("r"))), [image, "b"]).groupBy(image, F.col("a").alias("id")).agg(F.min("r").alias("r"))
        spread = now.join(dealt(seen), [image, "id"], "left").select(image, "id", F.col("root").alias("old"), F.least("root", F.coalesce("r", "root")).alias("root"))
        jump = spread.select(image, F.col("id").alias("root"), F.col("root").alias("to"))
        then = checkpointed(spread.join(dealt(jump), [image, "root"]).select(image, "id", "old", F.least("root", "to").alias("root")))
        changed = not then.where("root != old").isEmpty()
        now = then.select(image, "id", "root")
        if not changed:
            return now


STRIP = 512


def runs(mask: DataFrame, keys: tuple[str, ...] = ("image_id",), sums: tuple[str, ...] = ()) -> DataFrame:
    """(keys, y, x0, x1, id, n, sx, s<column>...) of the longest runs of masked pixels (keys, y, x, ...) in each row, with the sums of columns over
    their pixels; id orders runs by y, then x0."""
    in_row = Window.partitionBy(*keys, "y").orderBy("x")
    found = mask.withColumn("g_", F.col("x") - F.row_number().over(in_row)).groupBy(*keys, "y", "g_")
    found = found.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("n"), F.sum("x").alias("sx"), *(F.sum(c).alias(f"s{c}") for c in sums)).drop("g_")
    return found.withColumn("id", F.col("y").cast("long") * F.lit(1 << 24) + F.col("x0"))


def _strip_root(pdf):
    """Each run's least connected run inside one strip; runs come in any order."""
    pdf = pdf.sort_values("id")
    ys, lefts, rights, ids = (pdf[c].tolist() for c in ("y", "x0", "x1", "id"))
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    above = 0  # the first run of the row above that may touch this one
    for i, (y, x0, x1) in enumerate(zip(ys, lefts, rights, strict=True)):
        while above < i and (ys[above] < y - 1 or ys[above] == y - 1 and rights[above] < x0 - 1):
            above += 1
        j = above
        while j < i and ys[j] == y - 1 and lefts[j] <= x1 + 1:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
            j += 1
    return pdf.assign(root=[ids[find(i)] for i in range(len(ids))])


def pixel_components(mask: DataFrame, keys: tuple[str, ...] = ("image_id",), sums: tuple[str, ...] = (), strip: int = STRIP) -> DataFrame:
    """`runs` of a mask, each with its 8-connected component's least run id as `root`.

    Runs are joined inside strips of `strip` rows, one task each; then only components that meet a strip's border spread their labels
    in rounds, so a strip and the borders' graph are all that has to fit anywhere."""
    rows = runs(mask, keys, sums).withColumn("strip", F.floor(F.col("y") / strip).cast("long"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", root long"
    rows = checkpointed(rows.groupBy(*keys, "strip").applyInPandas(_strip_root, fields))
    image = F.struct(*keys)
    low = rows.where((F.col("y") + 1) % strip == 0).select(image.alias("image"), (F.col("y") + 1).alias("y"), "x0", "x1", F.col("root").alias("a"))
    high = rows.where(F.col("y") % strip == 0).select(image.alias("image"), "y", F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("root").alias("b"))
    edges = low.join(dealt(high), ["image", "y"]).where("u0 <= x1 + 1 and u1 >= x0 - 1").select("image", "a", "b").distinct()
    edges = checkpointed(edges)
    if edges.isEmpty():
        return rows.drop("strip")
    nodes = edges.select("image", F.col("a").alias("id")).unionByName(edges.select("image", F.col("b").alias("id"))).distinct()
    found = components(nodes, edges, "image").select(*(F.col(f"image.{k}").alias(k) for k in keys), F.col("id").alias("root"), F.col("root").alias("whole"))
    return rows.join(dealt(found), [*keys, "root"], "left").withColumn("root", F.coalesce("whole", "root")).drop("strip", "whole")


def numbered(df: DataFrame, order: tuple[str, ...], name: str, first: int = 0) -> DataFrame:
    """df with `name`: numbers from `first` on in the order of the columns. Rows are dealt by ranges and numbered there; the driver gets one count
    for each range."""
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()))
    at, starts = first, {}
    for r in sorted(ranged.groupBy("range_").agg(F.count("*").alias("n_")).collect(), key=lambda r: r.range_):
        starts[r.range_], at = at, at + r.n_
    start = F.try_element_at(F.create_map(*(F.lit(x) for pair in starts.items() for x in pair)), F.col("range_")) if starts else F.lit(first)
    number = F.row_number().over(Window.partitionBy("range_").orderBy(*order)) - 1
    return ranged.withColumn(name, (start + number).cast("long")).drop("range_")


def rounded(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")
