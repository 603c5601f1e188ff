"""Quality by importance resampling: which raw documents look drawn from the target text.

Words and pairs of words are hashed into `BUCKETS` buckets. Two bag models are counted, one over all raw documents and one over
the target's (labelled good; at most `TARGETS` rows, a documented bound, chosen by hash). A document's importance is
the mean log ratio of its n-grams' smoothed probabilities times min(their number, `WEIGHT`): the log of the models' ratio, tempered for
long texts, lest their length alone outweigh the noise. Documents are resampled without replacement by Gumbel top-k: importance plus
Gumbel noise (from a hash of id and text, hence repeatable), and the k = ceil(`share` * rows) largest stay. k is the operator's
feature; every document gets a row that says whether it stayed.

The counts of all documents are summed in each task and meet as `BUCKETS` numbers. The k-th largest value is found by counting
16 bits of the keys at a time (four small passes over ids and keys in the shared folder), not by a global sort.

Null and empty texts have importance `EMPTY`, the lowest; with no target rows all importances are 0. Rows with equal keys (repeated
ids and texts) at the cut are taken in no particular order, by a second cut, but exactly k rows stay. Null ids take part. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.llm._shared import WordHashes, claim, map_arrow, materialize, mix, shingle_hashes, taken, word_hashes

BUCKETS, TARGETS, SHARE, WEIGHT, SMOOTH, EMPTY, SEED = 1 << 16, 20_000, 0.8, 200, 1.0, -1e6, 29
_words = WordHashes()


def buckets(text: str | None, n: int = BUCKETS) -> np.ndarray:
    """Buckets of a text's words and pairs of words."""
    words = word_hashes(text or "", _words)
    grams = np.concatenate([mix(words + np.uint64(1)), shingle_hashes(words, 2)]) if len(words) > 1 else mix(words + np.uint64(1))
    return (grams % np.uint64(n)).astype(np.int64)


def ratios(target: np.ndarray, raw: np.ndarray, target_total: int, raw_total: int, n: int) -> np.ndarray:
    """Log ratios of buckets' probabilities from their counts, the target's drawn towards the raw model."""
    if target_total <= 0 or raw_total <= 0:
        return np.zeros(len(raw))
    base = (raw + SMOOTH) / (raw_total + SMOOTH * n)
    strength = n / 4
    return np.log((target + strength * base) / (target_total + strength) / base)


class Ratio:
    """Bucket counts of the target and of all raw texts."""

    def __init__(self, target: np.ndarray, raw: np.ndarray):
        self.target, self.raw = target, raw
        self.target_total, self.raw_total = int(target.sum()), int(raw.sum())
        self.whole = ratios(target, raw, self.target_total, self.raw_total, len(raw))

    def importance(self, text: str | None, good: bool = False) -> float:
        """Of a text; one of the target is left out of both models while it is scored, lest it speak for itself."""
        found = buckets(text, len(self.raw))
        n = len(found)
        if not n:
            return EMPTY
        if good:
            at, own = np.unique(found, return_counts=True)
            return float((ratios(self.target[at] - own, self.raw[at] - own, self.target_total - n, self.raw_total - n, len(self.raw)) * own).sum() / n * min(n, WEIGHT))
        return float(self.whole[found].mean() * min(n, WEIGHT))


def gumbel(*columns: str):
    """Standard Gumbel noise from a hash of the columns."""
    u = (F.pmod(F.xxhash64(F.lit(SEED), *columns), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def _counts(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts over all rows (id, t, good): of all, and of the good ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("resampling", _words.clear)
        sums = np.zeros((2, n), np.int64)
        for batch in batches:
            good = batch.column(1).to_numpy(zero_copy_only=False)
            for start, stop, texts in taken(batch.column(0)):
                sets = [buckets(t, n) for t in texts]
                sums[0] += np.bincount(np.concatenate(sets), minlength=n)
                if some := [s for s, g in zip(sets, good[start:stop], strict=True) if g]:
                    sums[1] += np.bincount(np.concatenate(some), minlength=n)
        kind, at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(sums[kind, at])], ["kind", "at", "n"])

    out = np.zeros((2, n), np.int64)
    for r in docs.select("t", "good").mapInArrow(run, "kind int, at int, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect():
        out[r.kind, r.at] = r.n
    return out[0], out[1]


def cut(keys: DataFrame, k: int) -> tuple[int, int]:
    """The k-th largest `key` (long), and how many rows with that key belong to the k largest. 1 <= k <= rows."""
    high, left = 0, k
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned("key", shift).bitwiseAND(0xFFFF)
        rows = keys if shift == 48 else keys.where(F.shiftrightunsigned("key", shift + 16) == high)
        for r in sorted(rows.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.d):
            if left <= r.n:
                high = high << 16 | r.d
                break
            left -= r.n
    return high, left


def resample(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", share: float = SHARE, targets: int = TARGETS, n: int = BUCKETS) -> DataFrame:
    """doc_id, importance, noisy (importance plus noise) and kept of every row."""
    spark = df.sparkSession
    good = labels.where(F.col(label) == 1).select(F.col(doc_id).alias("g")).where("g is not null").distinct().orderBy(F.xxhash64(F.lit(SEED), "g"), "g").limit(targets)
    docs = df.select(F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("t"))
    marked = docs.join(F.broadcast(good.withColumn("good", F.lit(True))), F.col("i") == F.col("g"), "left").select("i", "t", F.coalesce("good", F.lit(False)).alias("good"))
    raw, target = _counts(marked, n)
    ratio = spark.sparkContext.broadcast(Ratio(target, raw))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scores = [ratio.value.importance(t, g) for t, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), batch.column(3)], ["doc_id", "importance", "noise"])

    noisy = marked.withColumn("noise", gumbel("i", "t"))
    scored = map_arrow(noisy, run, "doc_id long, importance double, noise double").withColumn("noisy", F.col("importance") + F.col("noise")).drop("noise")
    # A long whose order is that of the value: non-negative, in steps of 1e-9. `row` parts rows with one key; it is written with them, hence fixed.
    scored = materialize(scored.withColumns({"key": F.greatest(F.lit(0), F.round((F.col("noisy") + 2e6) * 1e9)).cast("long"), "row": F.monotonically_increasing_id()}), "keys")
    rows = scored.count()
    k = math.ceil(share * rows)
    if not k:
        return scored.select("doc_id", "importance", "noisy", F.lit(False).alias("kept"))
    least, left = cut(scored, k)
    kept = F.col("key") >= least
    at = scored.where(F.col("key") == least)
    if at.count() > left:
        last, _ = cut(at.select(F.col("row").alias("key")), left)
        kept = (F.col("key") > least) | ((F.col("key") == least) & (F.col("row") >= last))
    return scored.select("doc_id", "importance", "noisy", kept.alias("kept"))


def op8_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
