"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the 64-bit hashes of its distinct runs of k words. Sets are ordered by a global order, rare shingles
first. If two sets are as similar as asked for, the prefixes of n - least overlap + l shingles share at least l. Each
document chooses its own l: the prefix is lengthened while the estimated cost (shared places, and verifications of
candidates that share l of them by chance) falls. A pair is verified only if it shares as many prefix shingles as its two
lengthened prefixes demand: min(l, l') for the least alike sizes, more for nearer ones (`needed`).

1. One pass over the texts gives each set's size and a 128-bit fingerprint, and counts all shingles in a sketch of
   fixed width (counts of hash buckets). Equal sets become one class, represented by the least doc_id.
2. A second pass gives the prefixes of the classes. Spread by shingle and sorted, those of one document only are left out; the
   others get the list's first document as its hub.
3. Each document goes to the hub that it shares most with; hubs go to their own hubs. For each such group, what a member's
   set and the first hub's do not share is kept. Links inside a group are found from these differences (`_within`), without
   pairs of all members even where most of them are not linked.
4. What is left are pairs of different groups. Lists within one group are skipped; pairs across groups are counted, filtered by
   what they share and by length, and verified. No cap is set on lists or candidates. Components of all links, spread to the
   copies, are the result.

Verification sends each document's text to its hub's place, in salted parts, and compares whole sets. Tables between steps
are Parquet files in the shared folder.

Null and empty texts and texts without words have the empty set, are linked with nothing and are a component each. Where doc_ids
repeat, rows are told apart by a 64-bit hash of id and text; in `join` a repeated id's rows are merged into one component and come
out once for each row. A null doc_id gets a null component. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernglass.llm._graph import components
from fernglass.llm._shared import SLICE_CHARS, WordHashes, claim, materialize, mix, scratch, shingle_hashes, taken, word_hashes

LEVELS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
#: Cost of a verification in units of a shared place; width of the sketches; estimated count from which a shingle's list is
#: dealt to `SALTS` tasks; members of a hub that are verified together.
VERIFY, BITS, WIDE, SALTS, TOGETHER = 30.0, 20, 100_000, 64, 64
#: Members of a group that share a place from which families are looked for, and how often families of families are.
FAMILY, DEPTH = 24, 2
BLOCKS = 16
_words = WordHashes(200_000)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_hashes(word_hashes(text or "", _words), k))


def least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Shingles that a set of n shares at least with any set that is similar enough: ceil(n * percent / 100)."""
    return (n * percent + 99) // 100


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct arrays."""
    if not len(a) or not len(b) or min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(a) + len(b) - common)


def prefix(hashes: np.ndarray, weight: np.ndarray, percent: int, floor: float = 0.0) -> tuple[np.ndarray, int]:
    """The prefix in the global order (weight, hash), and its level l. weight: each shingle's count in the sketch; floor: what a bucket holds by chance."""
    n = len(hashes)
    if not n:
        return hashes, 0
    order = np.lexsort((hashes, weight))
    least = least_overlap(n, percent)
    places = np.cumsum(np.maximum(weight[order].astype(np.float64) - max(floor, 1), 0))
    best = None
    for level in LEVELS:
        if level > least:
            break
        size = n - least + level
        shared = places[size - 1]
        # A chance candidate needs `level` shared places; the longer prefix itself costs its rows.
        cost = size + shared + VERIFY * shared / level**2
        if best is None or cost < best[0]:
            best = cost, size, level
    return hashes[order[: best[1]]], best[2]


def needed(nx: Column, lx: Column, ny: Column, ly: Column, percent: int) -> Column:
    """Prefix shingles that two sets of these sizes and levels share at least if they are similar.

    The overlap must be o = ceil(percent (nx + ny) / (100 + percent)). Of the two prefixes take the one that ends first in the order: its shingles
    that the other set holds are in the other's prefix, so what is shared plus its set's rest (least_overlap(n) - l) must reach o. As either may
    end first, the smaller of the two demands counts. At equal sizes it grows with the size, and it is never below min(lx, ly)."""
    overlap = F.ceil((nx + ny) * percent / F.lit(100.0 + percent) - 1e-9)
    rest = lambda n, level: F.floor((n * percent + 99) / F.lit(100.0) + 1e-9) - level
    return F.greatest(F.lit(1), F.least(overlap - rest(nx, lx), overlap - rest(ny, ly)))


def least_needed(a: str, b: str, percent: int) -> Column:
    """What `needed` is at least for any two sets of sides a and b (columns lo and hi of sizes, least level); 1 less where rounding inside a range may take it."""
    overlap = lambda n, m: F.ceil((n + m) * percent / F.lit(100.0 + percent) - 1e-9)
    rest = lambda n, level: F.floor((n * percent + 99) / F.lit(100.0) + 1e-9) - level
    one = lambda s, t: overlap(F.col(f"{s}.hi"), F.col(f"{t}.lo")) - rest(F.col(f"{s}.hi"), F.col(f"{s}.level"))
    single = (F.col(f"{a}.lo") == F.col(f"{a}.hi")) & (F.col(f"{b}.lo") == F.col(f"{b}.hi"))
    return F.least(one(a, b), one(b, a)) - F.when(single, 0).otherwise(1)


def _place(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (mix(hashes) >> np.uint64(64 - bits)).astype(np.int64)


_COUNTS = "block int, salt int, places binary, counts binary"


def _blocks(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of _COUNTS for the places that are not zero."""
    partition = TaskContext.get().partitionId()
    for block, some in enumerate(np.split(counts, BLOCKS)):
        if len(at := np.flatnonzero(some)):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((block, pa.int32()), (partition % BLOCKS, pa.int32()), (at.astype(np.uint32).tobytes(), pa.binary()), (some[at].astype(np.int64).tobytes(), pa.binary()))], ["block", "salt", "places", "counts"])


def _total(parts: DataFrame, bits: int) -> np.ndarray:
    """Sum of the partial counts, in two steps; 2 ** bits numbers come to the driver, whatever the input."""
    size = (1 << bits) // BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, places, counts in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                held.setdefault(block, np.zeros(size, np.int64))[np.frombuffer(places, np.uint32)] += np.frombuffer(counts, np.int64)
        whole = np.zeros(1 << bits, np.int64)
        for block, some in held.items():
            whole[block * size : (block + 1) * size] = some
        yield from _blocks(whole)

    out = np.zeros(1 << bits, np.int64)
    for row in parts.repartition("block", "salt").mapInArrow(run, _COUNTS).repartition(BLOCKS, "block").mapInArrow(run, _COUNTS).collect():
        out[row.block * size + np.frombuffer(row.places, np.uint32)] += np.frombuffer(row.counts, np.int64)
    return out


def _scan(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """A row for each document (id, n, two fingerprints; block is null), and each task's part of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard", _words.clear)
        names, counts = ["id", "n", "f1", "f2", "block", "salt", "places", "counts"], np.zeros(1 << bits, np.int64)
        for batch in batches:
            ids = batch.column(0)
            for start, stop, texts in taken(batch.column(1)):
                sets = [shingles(t, k) for t in texts]
                first = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).astype(np.int64)
                second = np.array([np.bitwise_xor.reduce(mix(s + np.uint64(1))) if len(s) else 0 for s in sets], np.uint64).astype(np.int64)
                counts += np.bincount(_place(np.concatenate(sets), bits), minlength=1 << bits)
                none = pa.nulls(len(sets), pa.binary())
                yield pa.RecordBatch.from_arrays([ids[start:stop].cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(first), pa.array(second), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.int32()), none, none], names)
        for part in _blocks(counts):
            empty = pa.nulls(part.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([empty, empty, empty, empty, *part.columns], names)

    return docs.mapInArrow(run, f"id long, n long, f1 long, f2 long, {_COUNTS}")


def _prefixes(docs: DataFrame, k: int, percent: int, sketch: np.ndarray, bits: int) -> DataFrame:
    """id, n, fingerprints, level and prefix of each document with a set; heavy: which shingles have wide lists."""
    spark = docs.sparkSession
    load = float(sketch.sum()) / len(sketch)
    counts = spark.sparkContext.broadcast(np.minimum(sketch, np.iinfo(np.uint32).max).astype(np.uint32))
    floor = load + 3 * load**0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard", _words.clear)
        for batch in batches:
            ids = batch.column(0)
            for start, stop, texts in taken(batch.column(1)):
                rows = []
                for id, text in zip(ids[start:stop].to_pylist(), texts, strict=True):
                    if len(s := shingles(text, k)):
                        weight = counts.value[_place(s, bits)]
                        chosen, level = prefix(s, weight, percent, floor)
                        rows.append((id, len(s), int(mix(s).sum(dtype=np.uint64).astype(np.int64)), level, chosen.astype(np.int64)))
                if rows:
                    a, b, c, d, e = zip(*rows, strict=True)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in e])]), pa.int32()), pa.array(np.concatenate(e)))
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int32()), lists], ["id", "n", "f1", "level", "prefix"])

    return docs.mapInArrow(run, "id long, n long, f1 long, level int, prefix array<long>")


def _lists(places: DataFrame) -> DataFrame:
    """From (tok, salt, id, n, level): those whose list has more than one row, each with the list's first id as `hub`.

    Rows are dealt by (tok, salt) and sorted; a list streams through its task, of which one row is held. Parts of salted
    lists stay even with one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hub, waiting = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            tok, salt, id = (batch.column(i).to_numpy() for i in range(3))
            new = np.ones(len(tok), bool)
            new[1:] = (tok[1:] != tok[:-1]) | (salt[1:] != salt[:-1])
            new[0] = key != (tok[0], salt[0])
            runs = np.cumsum(new)  # 0: goes on from the last batch
            heads = np.flatnonzero(new)
            hubs = np.concatenate([[hub], id[heads]])[runs]
            long = np.bincount(runs, minlength=runs[-1] + 1) > 1
            long[0] = True
            keep = long[runs] | (salt >= 0)
            if waiting is not None and not new[0]:
                yield waiting
            waiting = None
            if not keep[-1]:  # the last list may go on
                waiting = pa.RecordBatch.from_arrays([*batch.slice(len(tok) - 1).columns, pa.array(hubs[-1:])], [*batch.schema.names, "hub"])
            key, hub = (tok[-1], salt[-1]), hubs[-1]
            yield pa.RecordBatch.from_arrays([*batch.filter(pa.array(keep)).columns, pa.array(hubs[keep])], [*batch.schema.names, "hub"])

    return places.repartition("tok", "salt").sortWithinPartitions("tok", "salt", "id").mapInArrow(run, "tok long, salt int, id long, n long, level int, hub long")


def _marked(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the ids: 2 ** bits bits, packed. Each task marks its own, and those of a block of places meet in one; the driver gets one row for a block."""
    names = ["block", "bits"]

    def rows(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([b.tobytes() for b in blocks.values()], pa.binary())], names)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            seen[_place(batch.column(0).to_numpy().astype(np.uint64), bits)] = True
        yield rows({block: np.packbits(some) for block, some in enumerate(np.split(seen, BLOCKS)) if some.any()})

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                some = np.frombuffer(raw, np.uint8)
                held[block] = held[block] | some if block in held else some
        yield rows(held)

    size = (1 << bits) // BLOCKS // 8
    out = np.zeros(BLOCKS * size, np.uint8)
    for row in ids.coalesce(32).mapInArrow(mark, "block int, bits binary").repartition(BLOCKS, "block").mapInArrow(united, "block int, bits binary").collect():
        out[row.block * size : (row.block + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return out


def _texts(docs: DataFrame, ids: DataFrame, bits: int = 24) -> DataFrame:
    """(id, text) of the documents with these ids. A Bloom filter of fixed size keeps the others out of the shuffle."""
    filter_ = docs.sparkSession.sparkContext.broadcast(_marked(ids, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = _place(batch.column(0).to_numpy().astype(np.uint64), bits)
            yield batch.filter(pa.array((filter_.value[place >> 3] >> (7 - (place & 7)) & 1).astype(bool)))

    return docs.mapInArrow(run, "id long, text string")


def _gathered(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of `wanted` (id, hub, part, role, size) with their texts, dealt by (hub, part), role 0 first. A text is shuffled once by id, once more for each row."""
    texts = _texts(docs, wanted.select("id").distinct())
    return texts.join(wanted, "id").select("hub", "part", "role", "size", "id", "text").repartition("hub", "part").sortWithinPartitions("hub", "part", "role", "id")


def _parts(x: str, most: Column) -> Column:
    """Which of ceil(most / TOGETHER) parts of a hub a member goes to."""
    return F.pmod(F.xxhash64(x), F.greatest(F.lit(1), F.ceil(most / TOGETHER))).cast("int")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (x, hub) whose texts are similar enough, as edges (a, b)."""
    sizes = pairs.groupBy("hub").agg(F.count("*").cast("long").alias("size"))
    members = materialize(pairs.join(sizes, "hub").select(F.col("x").alias("id"), "hub", _parts("x", F.col("size")).alias("part"), F.lit(1).alias("role"), "size"), "pairs")
    wanted = members.unionByName(members.select("hub", "part", "size").distinct().select(F.col("hub").alias("id"), "hub", "part", F.lit(0).alias("role"), "size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard", _words.clear)
        key, held = None, None
        for batch in batches:
            a, b = [], []
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 4)]
            for start, stop, texts in taken(batch.column(5)):
                for hub, part, role, x, text in zip(*(c[start:stop] for c in columns), texts, strict=True):
                    s = shingles(text, k)
                    if role == 0:
                        key, held = (hub, part), s
                    elif key == (hub, part) and similar(s, held, percent):
                        a.append(x)
                        b.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _gathered(wanted, docs).mapInArrow(run, "a long, b long")


def _differences(groups: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """For groups (id, hub), each of which has its hub as a member: (hub, size, x, n, slack, diff), diff being what x's set and the hub's do not share.

    slack = (100 - percent) n - (100 + percent) |diff|. Groups of two have empty lists instead: with slacks they are settled."""
    sizes = groups.groupBy("hub").agg(F.count("*").cast("long").alias("size"))
    members = materialize(groups.join(sizes, "hub").select("id", "hub", _parts("id", F.col("size")).alias("part"), F.when(F.col("id") == F.col("hub"), 0).otherwise(1).alias("role"), "size"), "members")
    parts = members.where("role = 1").select("hub", "part", "size").distinct()
    wanted = members.where("role = 1").unionByName(parts.select(F.col("hub").alias("id"), "hub", "part", F.lit(0).alias("role"), "size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard", _words.clear)
        key, held = None, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for start, stop, texts in taken(batch.column(5), SLICE_CHARS // 4):
                rows = []
                for hub, part, role, size, x, text in zip(*(c[start:stop] for c in columns), texts, strict=True):
                    s = shingles(text, k)
                    if role == 0:
                        key, held = (hub, part), s
                        rows.append((hub, size, x, len(s), (100 - percent) * len(s), s[:0], part))
                    elif key == (hub, part):
                        diff = np.setxor1d(s, held, assume_unique=True)
                        rows.append((hub, size, x, len(s), (100 - percent) * len(s) - (100 + percent) * len(diff), diff if size > 2 else s[:0], part))
                if rows:
                    *flat, lists, part = zip(*rows, strict=True)
                    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]), pa.int32())
                    diffs = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(lists).astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in flat), diffs, pa.array(part, pa.int32())], ["hub", "size", "x", "n", "slack", "diff", "part"])

    found = _gathered(wanted, docs).mapInArrow(run, "hub long, size long, x long, n long, slack long, diff array<long>, part int")
    first = parts.groupBy("hub").agg(F.min("part").alias("first"))  # a hub stands in each part of its group, and counts in one
    hubs, others = found.where("x = hub"), found.where("x != hub")
    return others.unionByName(hubs.join(first, (hubs["hub"] == first["hub"]) & (hubs["part"] == first["first"]), "left_semi")).drop("part")


def _tops(diffs: DataFrame) -> DataFrame:
    """The largest slack of each group, the least x that has it, and the least slack."""
    tops = diffs.groupBy("hub").agg(F.max(F.struct("slack", (-F.col("x")).alias("x"))).alias("t"), F.min("slack").alias("low"))
    return tops.select("hub", F.col("t.slack").alias("top"), (-F.col("t.x")).alias("best"), "low")


def _families(rows: DataFrame, centred: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(hub, x, family) of members with the first member of the list that they share most places with; and the differences of a family's members (it among them) from that one's."""
    lists = rows.groupBy("hub", "tok").agg(F.min("x").alias("s"), F.count("*").alias("c")).where("c > 1").drop("c")
    votes = rows.select("hub", "tok", "x").join(lists, ["hub", "tok"]).where("x != s").groupBy("hub", "x", "s").agg(F.count("*").alias("shared"))
    best = votes.groupBy("hub", "x").agg(F.max(F.struct("shared", (-F.col("s")).alias("s"))).alias("b"))
    best = materialize(best.select("hub", "x", (-F.col("b.s")).alias("family")), "families")
    sizes = best.groupBy("hub", "family").agg((F.count("*") + 1).cast("long").alias("size"))
    heads = sizes.join(centred.select("hub", F.col("x").alias("family"), F.col("n").alias("n_head"), F.col("diff").alias("head")), ["hub", "family"])
    apart = F.concat(F.array_except("diff", "head"), F.array_except("head", "diff"))
    others = best.join(heads, ["hub", "family"]).join(centred.select("hub", "x", "n", "diff"), ["hub", "x"]).select(F.col("family").alias("hub"), "size", "x", "n", apart.alias("diff"))
    own = heads.select(F.col("family").alias("hub"), "size", F.col("family").alias("x"), F.col("n_head").alias("n"), F.slice("head", 1, 0).alias("diff"))
    return best, others.unionByName(own).withColumn("slack", (100 - percent) * F.col("n") - (100 + percent) * F.size("diff"))


def _within(diffs: DataFrame, percent: int, depth: int = 0) -> list[DataFrame]:
    """Edges (a, b) that join what is linked inside the groups of `_differences`, without pairs of all members.

    The sets of x and y differ by |Dx| + |Dy| - 2c where c counts what their differences from any third set share. They are linked when
    slack(x) + slack(y) + 2 (100 + percent) c >= 0. So
    1. if the slacks alone suffice, x and y are both linked to the member with the largest slack: one edge each;
    2. any other link has a member u that the slacks don't link to that one, and needs a c of its own. Differences are ordered, rare ones first, and
       prefixes cut by the least c that a partner of such a u, or u itself, can do with; a pair is made at a shared shingle only if both have
       enough places from there on. Exact counts then decide.
    Before 2, differences are taken from the set of what most of the group's members hold: what the hub alone has or lacks would else be shared by all.

    What several families below half of a group share among themselves is still in their differences. So where more than `FAMILY` members share a place, members go to
    the one that they share most places with, links inside such a family are found in the same way from the differences to that one, and 2 makes
    pairs of different families only."""
    q = 2 * (100 + percent)
    sure = lambda d, t: d.join(t, "hub").where("slack + top >= 0 and x != best").select(F.col("x").alias("a"), F.col("best").alias("b"))
    tops = materialize(_tops(diffs), "tops")
    edges = [sure(diffs, tops)]
    loose = tops.where("low + top < 0").select("hub")
    open_ = diffs.where("size > 2").join(loose, "hub", "left_semi")
    counts = open_.select("hub", "size", F.explode("diff").alias("tok")).groupBy("hub", "tok").agg(F.count("*").alias("c"), F.max("size").alias("size"))
    counts = materialize(counts.where("c > 1"), "counts")
    most = counts.where("2 * c > size").groupBy("hub").agg(F.collect_list("tok").alias("most"))  # no longer than twice the members' mean difference
    flipped = F.when(F.col("most").isNull(), F.col("diff")).otherwise(F.concat(F.array_except("diff", "most"), F.array_except("most", "diff")))
    centred = open_.join(most, "hub", "left").select("hub", "x", "n", flipped.alias("diff"))
    centred = materialize(centred.withColumn("slack", (100 - percent) * F.col("n") - (100 + percent) * F.size("diff")), "centred")
    tops = materialize(_tops(centred), "tops")
    edges.append(sure(centred, tops))

    rare = counts.select("hub", "tok", F.when(F.expr("2 * c > size"), F.col("size") - F.col("c")).otherwise(F.col("c")).alias("c")).where("c > 1")
    rows = centred.join(tops, "hub").select("hub", "x", "slack", "top", F.expr("slack + top < 0").alias("u"), F.explode("diff").alias("tok")).join(rare, ["hub", "tok"])
    back = Window.partitionBy("hub", "x").orderBy(F.col("c").desc(), F.col("tok").desc())
    least = lambda other: F.greatest(F.lit(1), F.ceil(-(F.col("slack") + other) / q))
    rows = rows.withColumns({"room": F.row_number().over(back), "own": least(F.col("top")), "other": least(F.least(F.col("top"), -F.col("top") - 1))})
    rows = materialize(rows.where((F.col("room") >= F.col("other")) | (F.col("u") & (F.col("room") >= F.col("own")))).select("hub", "tok", "x", "slack", "u", "room", "own", "other"), "places")
    rows = rows.withColumn("family", F.col("x"))
    if depth < DEPTH and not rows.groupBy("hub", "tok").agg(F.count("*").alias("c"), F.max("u").alias("u")).where((F.col("c") > FAMILY) & F.col("u")).isEmpty():
        families, inner = _families(rows, centred, percent)
        edges += _within(materialize(inner, "inner"), percent, depth + 1)
        rows = rows.drop("family").join(families, ["hub", "x"], "left").withColumn("family", F.coalesce("family", "x"))
    us = rows.where("u and room >= own").select("hub", "tok", *(F.col(c).alias(f"{c}_u") for c in ("x", "slack", "room", "family")))
    need = F.greatest(F.lit(1), F.ceil(-(F.col("slack_u") + F.col("slack")) / q))
    both = us.alias("l").join(rows.where("room >= other").alias("r"), (F.col("l.hub") == F.col("r.hub")) & (F.col("l.tok") == F.col("r.tok")) & (F.col("family") != F.col("family_u")) & (~F.col("u") | (F.col("x_u") < F.col("x"))) & (need <= F.least("room", "room_u")))
    pairs = materialize(both.select(F.col("l.hub").alias("hub"), "x_u", "x").distinct(), "near")
    side = lambda x, d, s: centred.select("hub", F.col("x").alias(x), F.col("diff").alias(d), F.col("slack").alias(s))
    pairs = pairs.join(side("x_u", "diff_u", "slack_u"), ["hub", "x_u"]).join(side("x", "diff", "slack"), ["hub", "x"])
    shared = F.size(F.array_intersect("diff_u", "diff"))
    edges.append(pairs.where(F.col("slack_u") + F.col("slack") + q * shared >= 0).select(F.col("x_u").alias("a"), F.col("x").alias("b")))
    return edges


def _joined(docs: DataFrame, k: int, percent: int, bits: int, wide: int) -> tuple[DataFrame, DataFrame]:
    """(id, n) of the rows (id, text), and (id, component) of ids with links; ids that repeat have one set. Other tables are deleted when these two stand."""
    with scratch() as keep:
        scanned = keep(materialize(_scan(docs, k, bits), "sets"))
        found = keep(materialize(_linked(docs, scanned, k, percent, bits, wide), "groups"))
    return scanned.where("block is null").select("id", "n", "f1", "f2"), found


def _linked(docs: DataFrame, scanned: DataFrame, k: int, percent: int, bits: int, wide: int) -> DataFrame:
    keyed = docs.where("id is not null")
    rows = scanned.where("block is null").select("id", "n", "f1", "f2")
    sketch = _total(scanned.where("block is not null").select("block", "salt", "places", "counts"), bits)

    # Classes of equal sets, and the copies' edges to their least id.
    sets = rows.where("n > 0 and id is not null")
    classes = sets.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes, "classes")
    many = classes.where("copies > 1").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(15))))
    salted = sets.withColumn("s", F.pmod(F.col("id"), F.lit(16)).cast("int"))
    copies = materialize(salted.join(many, ["f1", "f2", "n", "s"]).where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct(), "copies")

    # Places of prefix shingles, of one document of each class.
    found = _prefixes(keyed, k, percent, sketch, bits).join(classes.select(F.col("rep").alias("id"), "f1", "n"), ["id", "f1", "n"], "left_semi")
    places = found.select("id", "n", "level", F.explode("prefix").alias("tok"))
    load = float(sketch.sum()) / len(sketch)
    if int(sketch.max(initial=0)) - load >= wide:  # which buckets hold such lists is as bounded as the sketch
        heavy = docs.sparkSession.sparkContext.broadcast(np.packbits(sketch - load >= wide))

        @F.pandas_udf("int")
        def salt(tok, id):
            import pandas as pd

            place = _place(tok.to_numpy().view(np.uint64), bits)
            return pd.Series(np.where(heavy.value[place >> 3] >> (7 - (place & 7)) & 1, id.to_numpy() % SALTS, -1).astype(np.int32))

        places = places.withColumn("salt", salt("tok", "id"))
    else:
        places = places.withColumn("salt", F.lit(-1))
    lists = materialize(_lists(places.select("tok", "salt", "id", "n", "level")), "lists")

    # Groups: each document with the hub that it shares most with, if about as much as a set of its size would have to, and
    # the hubs of a dealt list with its least; hubs with their own hubs. What is missed here is found among the open lists.
    places = lists.where("id != hub").groupBy("id", "hub").agg(F.count("*").alias("shared"), F.min("level").alias("level"), F.max("n").alias("n"))
    enough = F.col("shared") * 2 >= needed(F.col("n"), F.col("level"), F.col("n"), F.col("level"), percent)
    best = places.where(enough).groupBy("id").agg(F.max(F.struct("shared", (-F.col("hub")).alias("hub"))).alias("best"))
    stars = best.select(F.col("id").alias("a"), (-F.col("best.hub")).alias("b"))
    dealt = lists.where("salt >= 0").select("tok", "hub").distinct()
    first = dealt.groupBy("tok").agg(F.min("hub").alias("least"))
    stars = stars.unionByName(dealt.join(first, "tok").where("hub != least").select(F.col("hub").alias("a"), F.col("least").alias("b")))
    groups = materialize(components(stars).withColumnRenamed("component", "hub"), "groups")
    diffs = materialize(_differences(groups, keyed, k, percent), "diffs")
    inside = _within(diffs, percent)

    # Lists that still hold several groups: pairs across them.
    named = lists.join(groups.withColumnRenamed("hub", "part"), "id", "left").select("tok", "id", "n", "level", F.coalesce("part", "id").alias("part"))
    open_ = named.groupBy("tok").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("tok")
    named = materialize(named.join(open_, "tok").distinct(), "open")
    # A pair is made at the first shingle that it shares, short lists first. From there on both documents must have as many
    # places (`room`) in open lists as the pair has to share, which rules out most pairs of long lists.
    named = named.join(named.groupBy("tok").agg(F.count("*").alias("wide")), "tok")
    back = Window.partitionBy("id", "n", "level").orderBy(F.col("wide").desc(), F.col("tok").desc())
    named = materialize(named.withColumn("room", F.row_number().over(back)), "rooms")
    sides = named.groupBy("tok", "part").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("level").alias("level"), F.max("room").alias("room"))
    close = (F.col("a.lo") * percent <= F.col("b.hi") * 100) & (F.col("b.lo") * percent <= F.col("a.hi") * 100)
    able = least_needed("a", "b", percent) <= F.least("a.room", "b.room")
    across = sides.alias("a").join(sides.alias("b"), (F.col("a.tok") == F.col("b.tok")) & (F.col("a.part") < F.col("b.part")) & close & able).select(F.col("a.tok").alias("tok"), F.col("a.part").alias("p"), F.col("b.part").alias("q"))
    left = named.select("tok", F.col("part").alias("p"), F.col("id").alias("x"), F.col("n").alias("nx"), F.col("level").alias("lx"), F.col("room").alias("rx"))
    right = named.select("tok", F.col("part").alias("q"), F.col("id").alias("hub"), F.col("n").alias("nh"), F.col("level").alias("lh"), F.col("room").alias("rh"))
    demand = needed(F.col("nx"), F.col("lx"), F.col("nh"), F.col("lh"), percent)
    sized = (F.col("nx") * percent <= F.col("nh") * 100) & (F.col("nh") * percent <= F.col("nx") * 100) & (demand <= F.least("rx", "rh"))
    pairs = across.join(left, ["tok", "p"]).alias("l").join(right.alias("r"), (F.col("l.tok") == F.col("r.tok")) & (F.col("l.q") == F.col("r.q")) & sized)
    pairs = pairs.groupBy("x", "hub").agg(F.min(demand).alias("needed"))
    shared = pairs.join(named.select(F.col("id").alias("x"), "tok"), "x").join(named.select(F.col("id").alias("hub"), "tok"), ["hub", "tok"])
    pairs = shared.groupBy("x", "hub").agg(F.count("*").alias("shared"), F.min("needed").alias("needed")).where("shared >= needed").select("x", "hub")
    edges = copies.unionByName(_verified(pairs, keyed, k, percent))
    for some in inside:
        edges = edges.unionByName(some)
    return components(edges)


def _repeats(docs: DataFrame) -> bool:
    return not docs.where("id is not null").groupBy("id").count().where("count > 1").isEmpty()


def _key(id: Column, text: Column) -> Column:
    """What stands for the id where ids repeat: a 64-bit hash of id and text, so that each text is judged for itself."""
    return F.when(id.isNotNull(), F.xxhash64(id, F.coalesce(text, F.lit(""))))


def join(df: DataFrame, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", bits: int = BITS, wide: int = WIDE) -> DataFrame:
    """doc_id, n_shingles and component_id of each row; a link is 100 * intersection >= percent * union."""
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    if not _repeats(docs):
        rows, found = _joined(docs, k, percent, bits, wide)
        out = rows.join(found.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left")
        return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    keys = materialize(docs.select(F.col("id").alias("doc_id"), _key(F.col("id"), F.col("text")).alias("key")), "keys")
    rows, found = _joined(docs.select(_key(F.col("id"), F.col("text")).alias("id"), "text"), k, percent, bits, wide)
    ids = keys.where("key is not null").distinct()
    same = ids.groupBy("doc_id").agg(F.min("key").alias("b"), F.count("*").alias("n")).where("n > 1")
    merged = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(ids.join(same, "doc_id").select(F.col("key").alias("a"), "b")))
    named = materialize(ids.join(merged, ids["key"] == merged["id"], "left").select("doc_id", "key", F.coalesce("component", "key").alias("c")), "named")
    least = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "c").select("doc_id", "key", "component_id")
    sizes = rows.where("id is not null").select("id", "n").distinct()
    whole = keys.where("key is not null").join(named, ["doc_id", "key"]).join(sizes, F.col("key") == F.col("id")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return whole.unionByName(rows.where("id is null").select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def one_of_each(df: DataFrame, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", bits: int = BITS, wide: int = WIDE) -> DataFrame:
    """The rows, with all their columns, but for those of whose group another with a smaller id stays.

    Where ids repeat, each row is judged by its own text: of rows with one id and one text one stays, and rows with one id but unlike texts
    all stay. Rows without words or without an id stay."""
    name = f"__gone_{uuid.uuid4().hex}"
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    if not _repeats(docs):
        gone = _joined(docs, k, percent, bits, wide)[1].where("id != component").select(F.col("id").alias(name))
        return df.join(gone, F.col(doc_id).cast("long") == F.col(name), "left_anti")
    keyed = docs.select(_key(F.col("id"), F.col("text")).alias("id"), "text")
    rows, found = _joined(keyed, k, percent, bits, wide)
    ids = docs.where("id is not null").select(F.col("id").alias("doc_id"), _key(F.col("id"), F.col("text")).alias("key")).distinct()
    first = ids.join(found, ids["key"] == found["id"]).select("doc_id", "key", "component")
    stays = first.groupBy("component").agg(F.min(F.struct("doc_id", "key"))["key"].alias("stays"))
    gone = materialize(first.join(stays, "component").where("key != stays").select(F.col("key").alias(name)), "gone")
    some = materialize(rows.where("n > 0 and id is not null").groupBy("id").count().where("count > 1").select(F.col("id").alias(name)), "again")
    columns = df.columns
    marked = df.withColumn(name + "k", _key(F.col(doc_id).cast("long"), F.col(text).cast("string")))
    kept = marked.join(gone, F.col(name + "k") == F.col(name), "left_anti")
    again = kept.join(some, F.col(name + "k") == F.col(name), "left_semi").dropDuplicates([name + "k"])
    return kept.join(some, F.col(name + "k") == F.col(name), "left_anti").unionByName(again).select(*(F.col(f"`{c}`") for c in columns))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85)


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), m AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""
