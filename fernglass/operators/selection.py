"""Order statistics of keys by counting digits, so that no key is sorted in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from fernglass.operators.components import checkpointed

BITS = 16


def order_statistics(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, n_, and a column for each share): the item at floor(share * n_) of a key's sorted values, from 0. Values are whole numbers; nulls don't count.

    Equal values are counted together first. Then 16 bits at a time, the highest first: a key's values that agree with what is known of its statistic are counted by
    their next digit, and running sums over the at most 65,536 digits tell the one in which it lies."""
    if not isinstance(rows.schema[value].dataType, IntegralType):
        raise ValueError(f"{value} must hold whole numbers")
    counts = checkpointed(rows.select(F.col(key).alias("k_"), F.col(value).cast("long").alias("v_")).where("v_ is not null").groupBy("k_", "v_").agg(F.count("*").alias("c_")))
    low, high = counts.agg(F.min("v_"), F.max("v_")).first()
    shift = next(s for s in (0, 16, 32, 48) if s == 48 or -(1 << (s + 15)) <= (low or 0) and (high or 0) < 1 << (s + 15))
    sizes = counts.groupBy("k_").agg(F.sum("c_").alias("n_"))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("which"), F.floor(F.col("n_") * share).alias("rank")) for name, share in shares.items()))).alias("w")
    known = sizes.select("k_", wanted).select(F.col("k_").alias("s_"), "w.which", "w.rank", F.lit(0).cast("long").alias("prefix"))
    first = True
    while shift >= 0:
        agrees = F.lit(True) if first else F.shiftright("v_", shift + BITS) == F.col("prefix")
        digit = F.shiftright("v_", shift) if first else F.shiftrightunsigned("v_", shift).bitwiseAND((1 << BITS) - 1)
        found = counts.join(known, F.col("k_").eqNullSafe(F.col("s_")) & agrees).groupBy("s_", "which", "prefix", "rank", digit.alias("digit")).agg(F.sum("c_").alias("c"))
        found = found.withColumn("upto", F.sum("c").over(Window.partitionBy("s_", "which").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)))
        here = found.where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
        known = checkpointed(here.select("s_", "which", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), (F.col("prefix") * (1 << BITS) + F.col("digit")).alias("prefix")))
        first, shift = False, shift - BITS
    wide = known.groupBy("s_").agg(*(F.max(F.when(F.col("which") == name, F.col("prefix"))).alias(name) for name in shares))
    return sizes.join(wide, F.col("k_").eqNullSafe(F.col("s_"))).select(F.col("k_").alias(key), "n_", *shares)
