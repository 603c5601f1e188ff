"""Helpers that the operators of this folder share: the shared folder, Arrow batches, word hashes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python worker turns into word lists at a time.
SLICE_CHARS = 2_000_000

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set to a new local folder only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fernglass-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back, which cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fernglass/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    if (tables := _scratch.get()) is not None:
        tables.append((out, path))
    return out


_scratch: ContextVar[list[tuple[DataFrame, str]] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are materialized inside are deleted at the end, but for those given to the function that it yields.

    What leaves the block must read kept tables only."""
    outer, tables, kept = _scratch.get(), [], []
    token = _scratch.set(tables)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _scratch.reset(token)
        for df, path in tables:
            if any(df is k for k in kept):
                if outer is not None:
                    outer.append((df, path))
            else:
                _delete(df.sparkSession, path)
                _written.remove((df.sparkSession, path))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: the folder's owner clears it
            return


def crc_mod(column: str, n: int):
    """crc32 of the column as text, modulo n; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` characters each, so that a batch of long texts needs bounded memory."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def taken(column: pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int, list[str | None]]]:
    """Ranges of rows of an Arrow text column with about `limit` bytes each, and their texts: only one range's are Python objects at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(column):
        before = int(ends[start - 1]) if start else 0
        stop = min(len(column), max(start + 1, int(np.searchsorted(ends, before + limit, "left")) + 1))
        yield start, stop, column.slice(start, stop - start).to_pylist()
        start = stop


_holders: dict[str, Callable[[], None]] = {}


def claim(name: str, clear: Callable[[], None] | None = None) -> None:
    """Say in a Python worker which operator works now: the caches that others left in it are emptied, and free memory goes back.

    Spark reuses its workers, so caches of one operator would else stay beside those of the next."""
    others = [n for n in _holders if n != name]
    for n in others:
        _holders.pop(n)()
    _holders[name] = clear or (lambda: None)
    if others:
        gc.collect()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over single batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from f(batch)

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hash of each word (bytes); emptied when it holds `limit` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(text: str, cache: WordHashes) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of a text with A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)
_A = np.uint64(0xBF58476D1CE4E5B9)
_B = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (the one of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; of the whole sequence if it is shorter; empty without words."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        out = mix((out + _MIX) ^ words[i : len(words) - k + 1 + i])
    return out
