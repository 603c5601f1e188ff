"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.llm._shared import materialize, scratch

SALT = 16


def _least(edges: DataFrame, key: str, other: str, salts: int = SALT) -> DataFrame:
    """(key, least of `other`), in two steps so that a hub's neighbours are first reduced in parts."""
    part = edges.groupBy(key, F.pmod(F.xxhash64(other), F.lit(salts)).alias("s")).agg(F.min(other).alias("m"))
    return part.groupBy(key).agg(F.min("m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in `edges` (a, b), where the component is the least id that can be reached.

    Each round writes its edges into the shared folder; the number of rounds grows with the logarithm of the longest path.
    Stars of a hub are joined with one row of it, which Spark can split. An empty table gives no rows."""
    with scratch() as keep:
        now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
        while True:
            then = materialize(_round(now), "edges")
            before, after = (e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first() for e in (now, then))
            now = then
            if before == after:
                break
        keep(now)
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))


def _round(now: DataFrame) -> DataFrame:
    # Large star: neighbours above a node go to its least neighbour (itself included).
    both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both, "a", "b").select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    # Small star: a node and its lower neighbours go to the least of these.
    least = _least(large, "a", "b").select(F.col("a").alias("k"), "m")
    joined = large.join(least, F.col("a") == F.col("k"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).where("a != b").distinct()
