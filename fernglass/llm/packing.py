"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document's ids (its end id included) are one piece; one of more than `piece` ids is cut into near-equal pieces of at most half as many.
Pieces gather in a pool inside the task that tokenized them. When a pool holds `pool` windows' worth of ids,
differencing splits it into near-equal windows: every piece starts as a partial partition, and the two partitions with the largest
imbalance are merged with the largest sums of one against the smallest of the other, until one is left. Where a window's sum
exceeds the capacity, the ids beyond it are cut off and stay in the pool, so that the number of windows rises by what they
need; nothing else is cut. What the last pool of a task has beyond its full windows goes into windows whose lengths are
powers of two, which are not padded.

Tokenizing and packing are one pass over the scan without any shuffle, so no key can be hot; a pool is all that a task
holds. Sequence ids are partition << 33 plus a running number, hence equal when a lost task runs again.

Each row holds its piece's ids, as little-endian 32-bit numbers in `ids`; a window is the rows of one sequence id, by
offset, one after the other.

Null and empty texts have the end id only; repeated rows are packed each for itself; a null id stays null; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.llm._shared import claim, taken

CAPACITY, END, PIECE, POOL = 4096, 2, 4096, 192
#: Rows and bytes of ids after which a task hands on a batch.
BATCH_ROWS, BATCH_BYTES = 10_000, 8_000_000

# Characters whose normal form and lower case do not depend on their neighbours, and the tokenizer's own words among them.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_LINES = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


class Known:
    """Ids of strings by their numbers, in one array; beyond `limit` strings the half that was used least goes."""

    def __init__(self, limit: int, dtype: type):
        self.limit, self.number = limit, {}
        self.ids, self.at, self.used = np.zeros(0, dtype), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def add(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.number.update(zip(names, range(len(self.used), len(self.used) + len(names)), strict=True))
        self.ids, self.at = np.concatenate([self.ids, ids.astype(self.ids.dtype)]), np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        self.used = np.concatenate([self.used, np.zeros(len(names), np.int64)])

    def shed(self) -> None:
        if len(self.used) > self.limit:
            keep = np.sort(np.argsort(-self.used, kind="stable")[: self.limit // 2])
            names = list(self.number)
            sizes = (self.at[1:] - self.at[:-1])[keep]
            ids, used = self.of(keep)[0], self.used[keep] // 2
            self.__init__(self.limit, self.ids.dtype.type)
            self.add([names[i] for i in keep.tolist()], ids, sizes)
            self.used = used

    def missing(self, names: list[str]) -> list[str]:
        return [n for n in names if n not in self.number]

    def numbers(self, names: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, names), np.int64, len(names))

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of strings one after the other, and how many each has."""
        first, sizes = self.at[numbers], self.at[numbers + 1] - self.at[numbers]
        return self.ids[np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())], sizes


class Ids:
    """Ids of texts as little-endian bytes, through caches of words; the same as the tokenizer's own for the whole text.

    Texts of plain characters are cut at white space, which the tokenizer drops, and unknown parts into the tokenizer's
    words here; unknown words go to its model together. Distinct parts of many texts are looked up once. Any other text goes
    to the tokenizer whole."""

    def __init__(self, path: str, limit: int = 250_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path = path
        self.words_only = Tokenizer.from_file(path)  # for words that are normal already
        self.words_only.normalizer = normalizers.Sequence([])
        self.words_only.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.words_only.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        kind = np.uint16 if len(self.last) <= 1 << 16 else np.uint32
        self.parts, self.words = Known(limit, kind), Known(limit // 2, kind)

    @cached_property
    def tokenizer(self):
        """The tokenizer itself, loaded when a text asks for it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn_words(self, new: list[str]) -> None:
        found, sizes = [], []
        for at in range(0, len(new), 256):
            some = new[at : at + 256]
            ids = np.array(self.words_only.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                each = [self.whole(w) for w in some]
                ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            found.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        if new:
            self.words.add(new, np.concatenate(found), np.concatenate(sizes))

    def _learn_parts(self, new: list[str]) -> None:
        # One line for each part: line ends are words of their own here.
        words = pa.array(_LINES.findall("\n".join(new)), pa.string()).dictionary_encode()
        names = words.dictionary.to_pylist()
        self.words.shed()
        self._learn_words([w for w in self.words.missing(names) if w != "\n"])
        of = np.array([-1 if w == "\n" else self.words.number[w] for w in names], np.int64)[words.indices.to_numpy()]
        part = np.cumsum(of < 0)[of >= 0]
        of = of[of >= 0]
        self.words.used += np.bincount(of, minlength=len(self.words.used))
        ids, sizes = self.words.of(of)
        self.parts.add(new, ids, np.bincount(part, sizes, len(new)).astype(np.int64))

    def of(self, texts: list[str]) -> list[bytes]:
        plain = [bool(_PLAIN.fullmatch(t)) and "<|" not in t for t in texts]
        cut = pc.ascii_split_whitespace(pc.utf8_lower(pa.array([t for t, p in zip(texts, plain, strict=True) if p], pa.string())))
        parts = cut.flatten().dictionary_encode()
        names = parts.dictionary.to_pylist()
        self.parts.shed()
        if new := self.parts.missing(names):
            self._learn_parts(new)
        numbers = self.parts.numbers(names)[parts.indices.to_numpy()]
        self.parts.used += np.bincount(numbers, minlength=len(self.parts.used))
        ids, sizes = self.parts.of(numbers)
        raw, ends = ids.astype("<u4").tobytes(), 4 * np.concatenate([[0], np.cumsum(sizes)])[cut.offsets.to_numpy()]
        found = map(raw.__getitem__, map(slice, ends[:-1].tolist(), ends[1:].tolist()))
        return [next(found) if p else self.whole(t).tobytes() for t, p in zip(texts, plain, strict=True)]


@cache
def ids_of(path: str) -> Ids:
    return Ids(path)


def split(sizes: list[int], ways: int) -> list[list[int]]:
    """Karmarkar-Karp: indexes of `sizes` in at most `ways` parts with near-equal sums.

    A partial partition keeps its sums less their least one, largest first, without zeros, and a node for each; nodes
    form trees whose leaves are the items."""
    n = len(sizes)
    left, right = [-1] * n, [-1] * n
    heap = [(-s, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, s, u = heapq.heappop(heap)
        _, _, t, v = heapq.heappop(heap)
        over = len(u) + len(v) - ways
        if over > 0:
            # The last `over` of u meet the last `over` of v, largest against smallest.
            keep_u, keep_v = len(u) - over, len(v) - over
            first = len(left)
            left += u[keep_u:].tolist()
            right += v[keep_v:][::-1].tolist()
            sums = np.concatenate([s[:keep_u], t[:keep_v], s[keep_u:] + t[keep_v:][::-1]])
            nodes = np.concatenate([u[:keep_u], v[:keep_v], np.arange(first, first + over)])
        else:
            sums, nodes = np.concatenate([s, t]), np.concatenate([u, v])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        low = int(sums[-1]) if len(sums) == ways else 0
        heapq.heappush(heap, (-(int(sums[0]) - low), a, sums - low, nodes))
    parts = []
    for node in heap[0][3].tolist() if heap else ():
        stack, items = [node], []
        while stack:
            x = stack.pop()
            if left[x] < 0:
                items.append(x)
            else:
                stack += (left[x], right[x])
        parts.append(sorted(items))
    return parts


class Packer:
    """Takes documents, gives rows (doc, start, length, crc, doc_tokens, sequence, offset); with `ids`, the ids' bytes instead of their crc."""

    def __init__(self, capacity: int, piece: int, pool: int, first: int, ids: bool = False):
        self.capacity, self.piece, self.pool, self.next, self.ids = capacity, piece, pool * capacity, first, ids
        self.held: list[tuple[int | None, int, bytes, int]] = []
        self.size = 0

    def add(self, doc: int | None, raw: bytes) -> Iterator[tuple]:
        total = len(raw) // 4
        ways = 1 if total <= self.piece else -(-2 * total // self.piece)
        at = [4 * (total * i // ways) for i in range(ways + 1)]
        self.held += [(doc, a // 4, raw[a:b], total) for a, b in zip(at, at[1:])]
        self.size += total
        if self.size >= self.pool:
            yield from self._flush(round(self.size / self.capacity))

    def _row(self, item: tuple, offset: int) -> tuple:
        doc, start, raw, total = item
        return doc, start, len(raw) // 4, raw if self.ids else zlib.crc32(raw), total, self.next, offset

    def _emit(self, items: list[tuple]) -> Iterator[tuple]:
        """A window; ids beyond the capacity are cut off and stay in the pool."""
        offset = 0
        for item in items:
            doc, start, raw, total = item
            room = self.capacity - offset
            if len(raw) > 4 * room:
                self.held.append((doc, start + room, raw[4 * room :], total))
                self.size += len(raw) // 4 - room
                item = doc, start, raw[: 4 * room], total
            if item[2]:
                yield self._row(item, offset)
                offset += len(item[2]) // 4
        self.next += 1

    def _flush(self, ways: int) -> Iterator[tuple]:
        held, self.held, self.size = self.held, [], 0
        for part in split([len(h[2]) // 4 for h in held], ways):
            yield from self._emit([held[i] for i in part])

    def _shed(self, n: int) -> list[tuple]:
        """n ids from the end of the pool, the last piece cut where needed."""
        out = []
        while n:
            doc, start, raw, total = self.held.pop()
            if len(raw) > 4 * n:
                cut = len(raw) - 4 * n
                self.held.append((doc, start, raw[:cut], total))
                start, raw = start + cut // 4, raw[cut:]
            out.append((doc, start, raw, total))
            n -= len(raw) // 4
            self.size -= len(raw) // 4
        return out

    def flush(self) -> Iterator[tuple]:
        """Empty the pool: full windows as long as there are ids for one, then windows of powers of two."""
        while self.size >= self.capacity:
            yield from self._flush(self.size // self.capacity)
        while self.size:
            yield from self._emit(self._shed(1 << (self.size.bit_length() - 1)))


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
DIGEST = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(df: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end: int = END, piece: int = PIECE, pool: int = POOL) -> DataFrame:
    """A row for each piece, with its ids and their crc32. `tokenizer` is the path of a tokenizers file with words that end in `</w>`, the same on all machines."""
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing", ids_of.cache_clear)
        ids, packer, rows = ids_of(tokenizer), Packer(capacity, piece, pool, TaskContext.get().partitionId() << 33, True), []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            names, kinds = zip(*(f.split() for f in SCHEMA.split(", ")), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "binary" else pa.int64()) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names)

        def parts(rows: list[tuple]) -> Iterator[list[tuple]]:
            start = size = 0
            for i, row in enumerate(rows):
                size += len(row[3])
                if size >= BATCH_BYTES or i - start + 1 >= BATCH_ROWS:
                    yield rows[start : i + 1]
                    start, size = i + 1, 0
            yield rows[start:]

        size = 0
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for start, stop, texts in taken(batch.column(1)):
                for doc, raw in zip(docs[start:stop], ids.of([t or "" for t in texts]), strict=True):
                    rows += packer.add(doc, raw + last)
                    size += len(raw)
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield from map(out, parts(rows))
                    rows, size = [], 0
        rows += packer.flush()
        yield from map(out, parts(rows))

    packed = df.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, SCHEMA)
    return packed.select(*(F.crc32("ids").alias(c) if c == "ids_crc32" else c for c in DIGEST), "ids")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")).select(*DIGEST)
