"""Importance resampling towards a target distribution, scored without exploding a document.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased; features are all runs of 1 to `order` consecutive words, joined by
a space, repeats counted. Higher-order functions make each document's array of buckets (crc32 of the feature modulo `n`), which is written to the shared
folder once. Two totals are counted from such arrays, over all documents and over all target texts: only a task's bucket counts are shuffled, and 2 x `n` numbers
reach the driver. They give each bucket a gain, floor(1000 * ln of the ratio of its smoothed shares), and a document's weight is the floored mean of
the gains of its features: an aggregate over element_at of the literal array of gains, so a document never leaves its row.

Documents with at least `least` words are drawn without replacement by Gumbel top-k: score is weight plus floored noise from a hash of the id, and
the floor(`share` * N / 100) highest scores are drawn, ties to the smaller id. Drawn rows are ranked by dealing the scores by ranges, so no task sorts all.

Null texts have no words; texts without words have weight 0 and are never drawn where `least` is positive. A null id is hashed as an empty one and comes first among
equal scores. Repeated rows count and are drawn each for itself; rows with one id have one noise, and where their scores are equal too, the order is that of their weights and features, then any. Without target texts, or
with empty tables, gains follow the same formula from zero counts. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from fernglass.llm._shared import materialize, scratch

BUCKETS, ORDER, LEAST, SHARE, SEED = 10_000, 2, 20, 25, 7


def words(text: Column) -> Column:
    """Words of a text: runs of digits, of letters (A-Z lower-cased) and of whatever lies beyond ASCII."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def buckets(words: Column, order: int = ORDER, n: int = BUCKETS) -> Column:
    """Buckets of all runs of 1 to `order` words."""
    runs, found = words, []
    for k in range(order):
        if k:
            left = F.greatest(F.size(words) - k, F.lit(0))
            runs = F.zip_with(F.slice(runs, F.lit(1), left), F.slice(words, F.lit(k + 1), left), lambda a, b: F.concat(a, F.lit(" "), b))
        found.append(F.transform(runs, lambda r: (F.crc32(r.cast("binary")) % n).cast("int")))
    return F.concat(*found)


def totals(arrays: DataFrame, n: int = BUCKETS) -> list[int]:
    """How often each bucket stands in the arrays `b`; each task sends its sums only."""
    out = [0] * n
    for r in arrays.select(F.explode("b").alias("at")).groupBy("at").agg(F.count("*").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def gains(raw: list[int], target: list[int]) -> list[int]:
    """floor(1000 * ln((t + 1)(S + n) / ((s + 1)(T + n)))) of each bucket, in doubles."""
    n, s_all, t_all = len(raw), sum(raw), sum(target)
    return [math.floor(1000 * math.log(float(t + 1) * float(s_all + n) / (float(s + 1) * float(t_all + n)))) for s, t in zip(raw, target, strict=True)]


def weight(b: Column, gain: list[int]) -> Column:
    """Floored mean of the gains of an array of buckets; 0 for an empty one."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded into one literal
    # In doubles the quotient of two integers below 2^53 has the floor of the exact one.
    return F.when(F.size(b) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(b, F.lit(0).cast("long"), lambda acc, x: acc + F.element_at(table, x + 1), lambda acc: F.floor(acc / F.size(b)).cast("long")))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 * standard Gumbel noise) from the first 32 bits of sha256 of `seed:id`."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(df: DataFrame, order: list[Column], name: str, most: int) -> DataFrame:
    """df with `name`: 1, 2, 3... for its first `most` rows in this order, else null. Rows are dealt by ranges; the driver gets a count for each range."""
    dealt = materialize(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranges")
    at, starts = 0, [(-1, 0)]
    for r in sorted(dealt.groupBy("range_").agg(F.count("*").alias("n_")).collect(), key=lambda r: r.range_):
        starts.append((r.range_, at))
        at += r.n_
    start = F.element_at(F.create_map(*(F.lit(x) for pair in starts for x in pair)), F.col("range_"))
    number = (start + F.row_number().over(Window.partitionBy("range_").orderBy(*order))).cast("long")
    return dealt.withColumn(name, F.when(number <= most, number)).drop("range_")


def importance(df: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", order: int = ORDER, n: int = BUCKETS, least: int = LEAST, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every row."""
    with scratch() as keep:
        split = df.select(F.col(doc_id).cast("long").alias("doc_id"), words(F.col(text)).alias("w"))
        arrays = materialize(split.select("doc_id", F.size("w").alias("n_words"), buckets(F.col("w"), order, n).alias("b")), "buckets")
        wanted = target.select(words(F.col(target_text)).alias("w")).select(buckets(F.col("w"), order, n).alias("b"))
        gain = gains(totals(arrays, n), totals(wanted, n))
        scored = arrays.select("doc_id", "n_words", F.size("b").cast("long").alias("n_features"), weight(F.col("b"), gain).alias("weight"))
        scored = materialize(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
        able = F.col("n_words") >= least
        drawn = ranked(scored.where(able), [F.desc("score"), F.asc("doc_id"), F.desc("weight"), F.desc("n_features")], "rank", share * scored.where(able).count() // 100)
        both = keep(materialize(drawn.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long"))), "drawn"))
    return both.select("doc_id", "n_features", "weight", "score", "rank")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: crc32 byte by byte, over the distinct features; the 256 steps come from its polynomial.
OP13_SQL = """
WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS step),
texts AS (
    SELECT 0 AS kind, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 1, NULL, coalesce(text, '') FROM benchmark
), numbered AS (
    SELECT *, row_number() OVER () AS row FROM texts
), cut AS (
    SELECT kind, doc_id, row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM numbered
), runs AS (
    SELECT kind, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM cut
), counted AS (
    SELECT kind, row, f, count(*) AS n FROM runs GROUP BY ALL
), hashed AS (
    SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c // 256, step[xor(c % 256, b) + 1])), 4294967295) % 10000 AS b
    FROM (SELECT DISTINCT f FROM counted), steps
), bucketed AS (
    SELECT c.kind, c.row, h.b, sum(c.n) AS n FROM counted c JOIN hashed h USING (f) GROUP BY ALL
), sums AS (
    SELECT b, coalesce(sum(n) FILTER (kind = 0), 0) AS s, coalesce(sum(n) FILTER (kind = 1), 0) AS t FROM bucketed GROUP BY b
), totals AS (
    SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM sums
), gained AS (
    SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM sums, totals
), weighed AS (
    SELECT x.row, sum(x.n) AS n_features, floor(sum(x.n * g.gain) / sum(x.n)) AS weight FROM bucketed x JOIN gained g USING (b) WHERE x.kind = 0 GROUP BY x.row
), scored AS (
    SELECT c.doc_id, len(c.w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || c.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0)))::BIGINT AS score
    FROM cut c LEFT JOIN weighed g USING (row) WHERE c.kind = 0
)
SELECT doc_id, n_features, weight, score,
    CASE WHEN n_words >= 20 AND row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) <= 25 * count(*) FILTER (n_words >= 20) OVER () // 100
        THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS rank
FROM scored
"""
