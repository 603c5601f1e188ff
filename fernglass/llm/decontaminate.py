"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items and documents are words (letters and digits, lower-cased). From each place of an item a seed runs as far as it takes to be
rare, 2 words at least and `SEED` at most: under the word frequencies of the whole corpus, independently drawn words would give it to at most `RATE` of
the corpus's places. That is a share, so the seeds of an item, and with them what is found, do not depend on how large the corpus is.
Frequencies are counted over all documents, for the items' words only, so copying an item a thousand times does
not make its seeds common. Where a seed meets a document, the item is aligned with the words around it; windows of
one item that overlap are joined. The local alignment's score over the score of a full match is the row's `score`, and rows from
`LEAST` on are reported, if `SEED` words' worth of score is reached too. A copy is missed only if every two or more neighbours that make a
seed were parted by its edits; tests hold what is found against aligning everything. An item with fewer than `SEED` words is sought
by its whole word sequence.

Items come to the driver in blocks of at most `ITEM_CHARS` characters; each block is a stated query set that runs against all
documents, whatever the number of blocks. Each block is one pass over the scan; nothing of the documents is shuffled.

Null and empty texts match nothing; items without words match nothing; repeated rows and items give repeated
results; null ids stay null; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.llm._shared import claim, map_arrow, slices

WORDS = re.compile(r"[^\W_]+")
SEED, RATE, LEAST, ITEM_CHARS = 4, 1e-6, 0.4, 4_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of the windows that are aligned side by side, the shorter ones padded.
AREA = 100_000


def words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def align(item: np.ndarray, windows: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """Smith-Waterman of an item with each window, side by side: (score, start, end) of the best local alignment.

    start and end are places in the window, the end exclusive; of equal scores the first end counts. Words are numbers."""
    width = max(map(len, windows))
    text = np.full((len(windows), width), -1, np.int64)
    for row, w in zip(text, windows, strict=True):
        row[: len(w)] = w
    back = np.full_like(text, -1)
    ends = []
    for forward in (True, False):
        if not forward:
            for row, w, (_, end) in zip(back, windows, ends, strict=True):
                row[:end] = w[:end][::-1]
        side = text if forward else back
        steps = GAP * np.arange(1, width + 1)
        before = np.zeros((len(windows), width + 1), np.int64)
        best, place = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
        for word in item if forward else item[::-1]:
            now = np.maximum(before[:, :-1] + np.where(side == word, MATCH, MISMATCH), before[:, 1:] + GAP)
            np.maximum(now, 0, out=now)
            # Gaps in the item: the best earlier cell of the row less one GAP for each step.
            now = np.maximum.accumulate(now - steps, axis=1) + steps
            before[:, 1:] = now
            at = now.argmax(1)
            top = now[np.arange(len(now)), at]
            better = top > best
            best[better], place[better] = top[better], at[better] + 1
        if forward:
            ends = list(zip(best.tolist(), place.tolist(), strict=True))
        else:
            return [(score, end - length, end) for (score, end), length in zip(ends, place.tolist(), strict=True)]
    return []


def _side_by_side(sizes: list[int], area: int = AREA) -> Iterator[list[int]]:
    """Windows in groups whose number times their longest is at most `area` (or one window), short ones first."""
    group: list[int] = []
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        if group and (len(group) + 1) * sizes[i] > area:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


class Items:
    """A block of items: numbers of their words, seeds and where in which items they stand."""

    def __init__(self, items: list[tuple[int | None, str]], counts: dict[str, int], total: int, seed: int = SEED, rate: float = RATE):
        self.ids, lists = [i for i, _ in items], [words(t) for _, t in items]
        self.seed = seed
        self.numbers = {w: n for n, w in enumerate(sorted({w for some in lists for w in some}), 1)}
        self.items = [np.array([self.numbers[w] for w in some], np.int64) for some in lists]
        share = np.zeros(len(self.numbers) + 1)
        for w, n in self.numbers.items():
            share[n] = max(counts.get(w, 0), 1) / max(total, 1)
        by_length: dict[int, dict[bytes, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, item in enumerate(self.items):
            n = len(item)
            if 0 < n < seed:
                by_length[n][item.tobytes()].append((k, 0))
            for i in range(n - 1 if n >= seed else 0):
                size = next((size for size in range(2, seed) if i + size <= n and np.prod(share[item[i : i + size]]) <= rate), seed)
                if i + size <= n:
                    by_length[size][item[i : i + size].tobytes()].append((k, i))
        self._there = np.zeros(len(self.numbers) + 1, bool)
        self.by_length = {n: dict(found) for n, found in by_length.items()}
        self._hashes = {n: np.unique([_roll(np.frombuffer(key, np.int64), n)[0] for key in found]) for n, found in self.by_length.items()}
        self._bits = {n: np.zeros(1 << 20, bool) for n in self._hashes}
        for n, hashes in self._hashes.items():
            self._bits[n][(hashes >> np.uint64(44)).astype(np.int64)] = True

    def seeds(self, numbers: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, place in it, place in the text) of each seed in word numbers (0: not an item's word)."""
        out = []
        for n, known in self.by_length.items():
            if len(numbers) >= n:
                live = numbers > 0
                inside = live[: len(live) - n + 1].copy()
                for i in range(1, n):
                    inside &= live[i : len(live) - n + 1 + i]
                inside = np.flatnonzero(inside)
                hashes = _roll(numbers, n)[inside]
                maybe = self._bits[n][(hashes >> np.uint64(44)).astype(np.int64)]
                inside, hashes = inside[maybe], hashes[maybe]
                slot = np.minimum(np.searchsorted(self._hashes[n], hashes), len(self._hashes[n]) - 1)
                for at in inside[self._hashes[n][slot] == hashes].tolist():
                    out += [(k, i, at) for k, i in known.get(numbers[at : at + n].tobytes(), ())]
        return out

    def matches(self, text: str | None, least: float = LEAST) -> list[tuple[int, float, int, int, int]]:
        """(item, score, seeds, first word, end word) of the document's best passage for each item, from `least` on."""
        return next(self.all_matches([text], least))

    def all_matches(self, texts: list[str | None], least: float = LEAST) -> Iterator[list[tuple[int, float, int, int, int]]]:
        """`matches` of each text. Seeds of many texts are sought together."""
        for start, stop in slices(texts):
            lists = [words(t) for t in texts[start:stop]]
            ends = np.cumsum([len(some) + 1 for some in lists])  # a 0 parts one text from the next
            get = self.numbers.get
            numbers = np.fromiter((get(w, 0) for some in lists for w in (*some, "")), np.int64, int(ends[-1]))
            found: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
            hits = self.seeds(numbers)
            for (k, i, at), doc in zip(hits, np.searchsorted(ends, [h[2] for h in hits], "right").tolist(), strict=True):
                found[doc][k].append(at - i)
            for doc, some in enumerate(lists):
                first = int(ends[doc]) - len(some) - 1
                yield self._best(numbers[first : first + len(some)], {k: [at - first for at in places] for k, places in found.get(doc, {}).items()}, least)

    def _common(self, k: int, window: np.ndarray) -> int:
        """Words of an item that a window has: as many as can be matched at most."""
        self._there[window] = True
        n = int(self._there[self.items[k]].sum())
        self._there[window] = False
        return n

    def _best(self, numbers: np.ndarray, found: dict[int, list[int]], least: float) -> list[tuple[int, float, int, int, int]]:
        """found: for each item the places in the text where it would start if a seed's words are all at their own distance."""
        out = []
        for k, places in sorted(found.items()):
            n = len(self.items[k])
            joined: list[list[int]] = []
            for at in sorted(places):
                start, end = max(0, at - n // 4 - 2), min(len(numbers), at + n + n // 4 + 2)
                if joined and start <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], end)
                else:
                    joined.append([start, end])
            full, best = MATCH * n, None
            enough = max(least * full, min(full, MATCH * self.seed))
            joined = [(start, end) for start, end in joined if MATCH * self._common(k, numbers[start:end]) >= enough]
            for group in _side_by_side([e - s for s, e in joined]):
                for j, (score, a, b) in zip(group, align(self.items[k], [numbers[slice(*joined[j])] for j in group]), strict=True):
                    if best is None or (-score, joined[j][0] + a) < (-best[0], best[1]):
                        best = score, joined[j][0] + a, joined[j][0] + b
            if best and best[0] >= enough:
                out.append((k, best[0] / full, len(places), best[1], best[2]))
        return out


def _roll(numbers: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n numbers."""
    out = np.zeros(len(numbers) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ numbers[i : len(numbers) - n + 1 + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _blocks(benchmark: DataFrame, text: str, item_id: str, limit: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items by id, in blocks of at most `limit` characters (or one item)."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).where("t is not null").orderBy("i", "t").toLocalIterator():
        if block and size + len(row.t) > limit:
            yield block
            block, size = [], 0
        block.append((row.i, row.t))
        size += len(row.t)
    if block:
        yield block


def _counted(docs: DataFrame, wanted: set[str]) -> tuple[dict[str, int], int]:
    """Occurrences of the wanted words in all documents, and the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("decontamination")
        counts: Counter[str] = Counter()
        total = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                some = words(text)
                total += len(some)
                counts.update(filter(wanted.__contains__, some))
        yield pa.RecordBatch.from_arrays([pa.array(["", *counts], pa.string()), pa.array([total, *counts.values()], pa.int64())], ["w", "n"])

    sums = {r.w: r.n for r in docs.select("t").mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    return sums, sums.pop("", 0)


SCHEMA = "doc_id long, item_id long, score double, seeds int, first_word long, end_word long"


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", seed: int = SEED, rate: float = RATE, least: float = LEAST, limit: int = ITEM_CHARS) -> DataFrame:
    """doc_id, item_id, score (0 to 1), number of seeds, and the passage's words [first_word, end_word) in the document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("t"))
    out = None
    for block in _blocks(benchmark, text, item_id, limit):
        items = spark.sparkContext.broadcast(Items(block, *_counted(rows, {w for _, t in block for w in words(t)}), seed, rate))

        def run(batch: pa.RecordBatch, items=items) -> Iterator[pa.RecordBatch]:
            claim("decontamination")
            found = [(doc, items.value.ids[k], *rest) for doc, some in zip(batch.column(0).to_pylist(), items.value.all_matches(batch.column(1).to_pylist(), least), strict=True) for k, *rest in some]
            columns = list(zip(*found, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "score", "seeds", "first_word", "end_word"])

        part = map_arrow(rows, run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def _clean(items, least: float):
    @F.pandas_udf("boolean")
    def clean(texts):
        import pandas as pd

        claim("decontamination")
        return pd.Series([not some for some in items.value.all_matches(texts.tolist(), least)], dtype=bool)

    return clean


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", seed: int = SEED, rate: float = RATE, least: float = LEAST, limit: int = ITEM_CHARS) -> DataFrame:
    """The rows, with all their columns, in which no item is found."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text).cast("string").alias("t"))
    for block in _blocks(benchmark, item_text, item_id, limit):
        items = spark.sparkContext.broadcast(Items(block, *_counted(rows, {w for _, t in block for w in words(t)}), seed, rate))

        docs = docs.where(_clean(items, least)(F.col(text).cast("string")))
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
