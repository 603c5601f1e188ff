"""Best-fit packing of whole documents by length patterns, fitted to the histogram of lengths by non-negative least squares.

A document's ids (its end id included) are one piece; only a longer one is cut, into pieces of `capacity` ids and a shorter last one. Pieces are counted
by length. The driver works on this histogram alone, at most `capacity` numbers whatever the corpus: patterns of one to three lengths that fill a
sequence exactly are enumerated (at most `most`; where there would be more, by a stride over the middle length), their repeat counts are fitted to the histogram by non-negative least squares
(coordinate descent, lengths weighted by their squares), and rounded down. What is left over is packed best fit, longest lengths first, many sequences at a time: all open
sequences with equal room that were opened together are one range, and a length's pieces go to the ranges with the least room that is enough.

Either way the result is a list of placements (length, first rank, how many, first sequence, pieces for each sequence, offset): pieces of one length are
ranked, and ranks go to sequences by arithmetic. A pattern makes three placements at most. A range holds at most 63 different lengths if `capacity` is 2048 (their sum is
the most that fits), and each length opens and splits two ranges at most: with 100,000 patterns fewer than 3 * 100,000 + 64 * 2 * 2,048 placements of 48 bytes (27 MB), however large the corpus.
They are what is sent to all tasks.

A piece's rank is its running number in the task that tokenized it plus the pieces of that length in earlier tasks, from a table with a row for each task and length. So
no length is gathered anywhere, however common, and copies of one text are dealt like all else. Pieces are written to the shared folder once, with their ids; then
only they are joined with the table of ranks.

Null and empty texts have the end id only; repeated rows are packed each for itself; a null id stays null; other columns are ignored, whatever their names. An empty
table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernglass.llm._shared import claim, materialize, scratch, taken
from fernglass.llm.packing import BATCH_BYTES, BATCH_ROWS, ids_of

CAPACITY, END, PATTERNS, SWEEPS = 2048, 0, 100_000, 12
#: Characters whose parts a task looks up at a time; more cost less each, as parts repeat.
SLICE = 6_000_000
_PIECE = "doc_id long, piece int, start long, length int, ids binary, part int, nth long"


def exact_patterns(counts: np.ndarray, capacity: int, most: int = PATTERNS) -> list[tuple[int, ...]]:
    """Lengths a >= b >= c that fill a sequence and stand in the histogram: of one, of two, of three pieces, the longest first."""
    there = counts > 0
    found: list[tuple[int, ...]] = [(capacity,)] if there[capacity] else []
    found += [(a, capacity - a) for a in range(capacity - 1, (capacity - 1) // 2, -1) if there[a] and there[capacity - a]]
    step = max(1, -(-capacity * capacity // (12 * most)))
    for a in range(capacity - 2, (capacity - 1) // 3, -1):
        if there[a]:
            rest = capacity - a
            b = np.arange(min(a, rest - 1), (rest - 1) // 2, -step)
            b = b[there[b] & there[rest - b]]
            found += [(a, x, rest - x) for x in b.tolist()]
    return found


def fitted(patterns: list[tuple[int, ...]], counts: np.ndarray, sweeps: int = SWEEPS) -> list[float]:
    """Non-negative repeat counts x with the least weighted ||counts - sum of x * pattern||, by coordinate descent. A length weighs with its square,
    since long pieces are the hardest to place afterwards."""
    weigh = ((np.arange(len(counts)) / (len(counts) - 1)) ** 2).tolist()
    left, x = counts.astype(float).tolist(), [0.0] * len(patterns)
    for _ in range(sweeps):
        moved = 0.0
        for k, p in enumerate(patterns):
            if len(p) == 3 and p[0] != p[1] and p[1] != p[2]:
                a, b, c = p
                d = (weigh[a] * left[a] + weigh[b] * left[b] + weigh[c] * left[c]) / (weigh[a] + weigh[b] + weigh[c])
            else:  # a length that stands twice in a pattern counts with its square
                times = [(a, p.count(a)) for a in dict.fromkeys(p)]
                d = sum(n * weigh[a] * left[a] for a, n in times) / sum(n * n * weigh[a] for a, n in times)
            if d < -x[k]:
                d = -x[k]
            if d:
                x[k] += d
                moved = max(moved, abs(d))
                for a in p:
                    left[a] -= d
        if moved < 0.25:
            break
    return x


#: A placement: ranks first..first+n of `length` go to sequences seq, seq+1, ..., `each` to a sequence, from `offset` on.
Placement = tuple[int, int, int, int, int, int]


def placed(counts: np.ndarray, capacity: int, most: int = PATTERNS) -> tuple[list[Placement], int]:
    """Placements of a histogram (counts[length]), and how many sequences they fill."""
    patterns = exact_patterns(counts, capacity, most)
    left, rank, seq, out = counts.astype(int).tolist(), [0] * (capacity + 1), 0, []

    def put(length: int, n: int, at: int, each: int, offset: int) -> None:
        out.append((length, rank[length], n, at, each, offset))
        rank[length] += n
        left[length] -= n

    for p, x in sorted(zip(patterns, fitted(patterns, counts), strict=True), key=lambda y: -y[1]):
        times = min([int(x), *(left[a] // p.count(a) for a in p)])
        if times > 0:
            offset = 0
            for a in dict.fromkeys(p):
                put(a, times * p.count(a), seq, p.count(a), offset)
                offset += a * p.count(a)
            seq += times
    rooms: list[int] = []  # sorted; ranges (first sequence, how many) by the room that is left
    ranges: dict[int, list[tuple[int, int]]] = {}

    def keep(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in ranges:
                insort(rooms, room)
                ranges[room] = []
            ranges[room].append((first, n))

    def fill(length: int, room: int, first: int, n: int) -> None:
        """Pieces of a length into n sequences with this room, as many as go; the last one may get fewer."""
        each = room // length
        whole = min(n, left[length] // each)
        if whole:
            put(length, whole * each, first, each, capacity - room)
            keep(room - each * length, first, whole)
        some = left[length] if whole < n else 0
        if some:
            put(length, some, first + whole, some, capacity - room)
            keep(room - some * length, first + whole, 1)
            whole += 1
        keep(room, first + whole, n - whole)

    for length in range(capacity, 0, -1):
        while left[length] and (at := bisect_left(rooms, length)) < len(rooms):
            room = rooms[at]
            first, n = ranges[room].pop()
            if not ranges[room]:
                del ranges[room], rooms[at]
            fill(length, room, first, n)
        if left[length]:
            n = -(-left[length] // (capacity // length))
            fill(length, capacity, seq, n)
            seq += n
    return out, seq


def _pieces(df: DataFrame, tokenizer: str, text: str, doc_id: str, capacity: int, end: int) -> DataFrame:
    """Pieces with their ids, the task's number and the running number of the length there."""
    last = np.array([end], "<u4").tobytes()
    names, kinds = zip(*(f.split() for f in _PIECE.split(", ")), strict=True)
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing", ids_of.cache_clear)
        ids, part, seen, rows, size = ids_of(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names)

        for batch in batches:
            docs = batch.column(0).to_pylist()
            for start, stop, texts in taken(batch.column(1), SLICE):
                for doc, raw in zip(docs[start:stop], ids.of([t or "" for t in texts]), strict=True):
                    raw += last
                    for i, at in enumerate(range(0, len(raw), 4 * capacity)):
                        piece = raw[at : at + 4 * capacity]
                        n = len(piece) // 4
                        rows.append((doc, i, at // 4, n, piece, part, int(seen[n])))
                        seen[n] += 1
                        size += len(piece)
                        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield out()
                            rows, size = [], 0
        yield out()

    return df.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, _PIECE)


def _sequences(ranked: DataFrame, placements: list[Placement]) -> DataFrame:
    """`ranked` (with length and rank) with sequence_id and offset, computed from the placements; the rank goes."""
    table = np.array(sorted(placements), np.int64).reshape(-1, 6)
    sent = ranked.sparkSession.sparkContext.broadcast(table)
    kept = [f for f in ranked.schema if f.name != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, first, _, seq, each, offset = sent.value.T
        keys = lengths << 40 | first
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 40 | rank, "right") - 1
            nth = rank - first[at]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(seq[at] + nth // each[at]), pa.array(offset[at] + nth % each[at] * length)], [*(f.name for f in kept), "sequence_id", "offset"])

    return ranked.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "sequence_id long", "offset long"]))


def pack(df: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end: int = END, patterns: int = PATTERNS, ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, its place (sequence_id, offset) and, with `ids`, its ids as little-endian 32-bit numbers.

    `tokenizer` is the path of a tokenizers file with words that end in `</w>`, the same on all machines."""
    with scratch() as keep:
        pieces = keep(materialize(_pieces(df, tokenizer, text, doc_id, capacity, end).withColumn("ids_crc32", F.crc32("ids")), "pieces"))
        held = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
        counts = np.zeros(capacity + 1, np.int64)
        for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect():
            counts[r.length] = r.n
        before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = keep(materialize(held.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "ranks"))
    columns = ["doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", *(["ids"] if ids else [])]
    ranked = pieces.join(starts, ["part", "length"]).select(*columns, (F.col("first") + F.col("nth")).alias("rank"))
    return _sequences(ranked, placed(counts, capacity, patterns)[0])


def op12_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the pieces; the ids stay in the operator's table and are not shuffled for them."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), ids=False)
