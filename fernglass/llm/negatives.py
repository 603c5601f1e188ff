"""Hard negatives by a Voronoi-partition distributed join of nearest neighbours.

Each component becomes floor(`scale` * x), and scores are integer inner products. Rows with a null id, label or vector, or with any null or non-finite
component take no part, nor do vectors whose squared length exceeds 2^52 after scaling (their scores fit no double exactly). Vectors of unlike lengths are filled
up with zeros. Anchors are rows whose id is divisible by `every`; an anchor's positives are its first `positives` other rows of its label, by score, ties to
the smaller id; its negatives for a positive are the first `negatives` rows of other labels whose score is `low` to `high` percent of the positive's.

**Distances.** With M the greatest length, a row v gets one more component, sqrt(M^2 - |v|^2), and an anchor a gets 0: then |a - v|^2 = |a|^2 + M^2 - 2 a.v, so
near means a high score, and triangle inequalities bound scores. Pivots are rows picked by hash, about the root of the rows' number and at most
`pivots`; each anchor belongs to its nearest pivot's cell, and a cell knows its radius, its anchors' least and greatest length and the least score that still
matters to one of them. Near cells are joined to groups of about `group` anchors; a cell with more is dealt to several.

**Passes.** First every row goes to the group of its nearest cell, where rows and anchors of one label are joined exactly; what an anchor finds there is the least score
that matters to it. Then rows go to those other groups whose cells' bounds say that they might serve an anchor of their label. The positives' scores
give each cell the range that its negatives' scores must lie in, and rows go to the groups whose bounds meet that range. Bounds only save work: each pass is an exact join, whatever they prune.

**Skew.** Rows with equal vectors and labels are interchangeable but for their ids: only the smallest `positives` + 1 ids of each are sought among (limited inside
tasks before they are shuffled), and equal anchors are answered once; the answers then go to all of them. What is routed to a group is counted first and cut into slices of
`rows` rows, so neither a crowded cell nor a label with a third of all rows is one task's; best rows of slices are merged. A task holds one group's anchors and one slice. The driver
holds pivots, and sums for each cell and each of 64 label classes; nothing else is collected.

Exactly repeated rows count once; rows with one id and unlike vectors or labels count each for itself, and "other" means another row. Anchors without positives, or without
negatives for them, give no rows. An empty table gives an empty one. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernglass.llm._shared import map_arrow, materialize, mix, scratch

EVERY, POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 50, 5, 3, 50, 95, 256
PIVOTS, GROUP, ROWS, KINDS, LONGEST = 2048, 32_768, 131_072, 64, 2**52
#: Scores that are computed at a time, and rows that are routed at a time.
BLOCK, STEP = 1 << 21, 1000
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of little-endian 32-bit numbers, filled up with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = pc.binary_length(vectors).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == 4 * dim).all():
        return np.frombuffer(b"".join(vectors.to_pylist()), "<i4").reshape(-1, dim).astype(float)
    out = np.zeros((len(sizes), dim))
    for i, raw in enumerate(vectors.to_pylist()):
        x = np.frombuffer(raw, "<i4")
        out[i, : len(x)] = x
    return out


def scaled(df: DataFrame, vec: str, vec_id: str, label: str, scale: int = SCALE) -> DataFrame:
    """Rows that take part: vec_id, label (as text), v (32-bit numbers), norm (squared length)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes).tolist()
        with np.errstate(over="ignore"):
            x = np.floor(scale * batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float))
            each = [x[e - n : e] for e, n in zip(ends, sizes.tolist(), strict=True)]
            norm = np.array([float(y @ y) for y in each])
        fits = norm <= LONGEST
        v = [y.astype("<i4").tobytes() if f else b"" for y, f in zip(each, fits.tolist(), strict=True)]
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(v, pa.binary()), pa.array(norm, pa.float64())], ["vec_id", "label", "v", "norm"])
        yield out.filter(pa.array(fits))

    whole = F.forall(F.col("x"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = df.select(F.col(vec_id).cast("long").alias("i"), F.col(label).cast("string").alias("l"), F.col(vec).cast("array<double>").alias("x"))
    return map_arrow(rows.where("i is not null and l is not null and x is not null").where(whole), run, "vec_id long, label string, v binary, norm double")


def best(anchors: np.ndarray, cands: np.ndarray, ids: np.ndarray, k: int, low: np.ndarray, high: np.ndarray, apart: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """(anchor, window, candidate, score): each anchor's k best candidates with a score in each of its windows low..high (anchors x windows),
    by score, then id; with `apart`, of other label codes only."""
    n, ways = low.shape
    exact = np.float32 if max(1.0, np.abs(anchors).max(initial=0)) * max(1.0, np.abs(cands).max(initial=0)) * anchors.shape[1] < 2**24 else np.float64
    a_all, c_all, least = anchors.astype(exact), cands.astype(exact), low.astype(float)
    held: list[tuple[np.ndarray, ...]] = []

    def shortened() -> tuple[np.ndarray, ...]:
        row, way, c, s = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 4
        key = row * ways + way
        order = np.lexsort((ids[c], -s, key))
        key = key[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        full = key[place == k - 1]
        least.reshape(-1)[full] = s[order][place == k - 1]
        order = order[place < k]
        return row[order], way[order], c[order], s[order]

    step, held_n = max(16, BLOCK // max(1, n)), 0
    for start in range(0, len(c_all), step):
        s = a_all @ c_all[start : start + step].T
        for way in range(ways):
            hit = (s >= least[:, way, None]) & (s <= high[:, way, None])
            if apart is not None:
                hit &= apart[0][:, None] != apart[1][None, start : start + step]
            row, c = np.nonzero(hit)
            if len(row):
                held.append((row, np.full(len(row), way), c + start, s[row, c].astype(np.int64)))
                held_n += len(row)
            if held_n > BLOCK // 4:
                held = [shortened()]
                held_n = len(held[0][0])
    return shortened()


@dataclass
class Cells:
    """Anchors' cells in groups. Cells of a bin stand side by side; a bin is a group, or several where its one cell is crowded."""

    pivots: np.ndarray  # cells x dim
    top: float  # M^2
    starts: np.ndarray  # first cell of each bin
    first: np.ndarray  # first group of each bin
    parts: np.ndarray  # groups of each bin

    @property
    def bin(self) -> np.ndarray:
        return np.searchsorted(self.starts, np.arange(len(self.pivots)), "right") - 1

    def extra(self, norms: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.top - norms))

    def of_anchors(self, x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest cell of each anchor and the distance."""
        dots = x @ self.pivots.T
        cell = dots.argmax(1)
        return cell, np.sqrt(np.maximum(0.0, norms + self.top - 2 * dots[np.arange(len(x)), cell]))

    def distances(self, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Of rows to the cells' pivots."""
        dots = x @ self.pivots.T + np.outer(self.extra(norms), self.extra((self.pivots**2).sum(1)))
        return np.sqrt(np.maximum(0.0, 2 * self.top - 2 * dots))


def chained(pivots: np.ndarray, top: float) -> np.ndarray:
    """An order of pivots in which each is followed by the nearest one that is left."""
    extra = np.sqrt(np.maximum(0.0, top - (pivots**2).sum(1)))
    left, order, at = np.ones(len(pivots), bool), [], 0
    while left.any():
        left[at] = False
        order.append(at)
        near = pivots @ pivots[at] + extra * extra[at]
        near[~left] = -np.inf
        at = int(near.argmax())
    return np.array(order, np.int64)


def grouped(pivots: np.ndarray, counts: np.ndarray, top: float, group: int) -> tuple[Cells, np.ndarray]:
    """Cells that hold anchors, in groups of about `group` anchors; and each pivot's cell (-1: none)."""
    full = np.flatnonzero(counts)
    order = full[chained(pivots[full], top)]
    starts, first, parts, held, groups = [], [], [], 0, 0
    for i, n in enumerate(counts[order].tolist()):
        if not starts or held + n > group:
            starts.append(i)
            first.append(groups)
            parts.append(max(1, -(-n // group)))
            groups += parts[-1]
            held = 0
        held += n
    cell = np.full(len(pivots), -1)
    cell[order] = np.arange(len(order))
    return Cells(pivots[order], top, np.array(starts), np.array(first), np.array(parts)), cell


def kind(labels: pa.Array) -> np.ndarray:
    """One of KINDS classes of each label."""
    names = labels.dictionary_encode()
    return np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) % KINDS for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()] if len(labels) else np.zeros(0, np.int64)


#: For rows' labels' classes, their distances to all cells and their home bins: which bins they go to.
Needs = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def routed(items: DataFrame, cells: Cells, needs: Needs, by_kind: bool, dim: int, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """Rows with each `unit` (a group, or a group and a class of labels) and `slice` that they go to; and the slices of each unit."""
    def goals(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows' numbers in the batch and the units that they go to."""
        of_cell = cells.bin
        for start in range(0, batch.num_rows, STEP):
            part = batch.slice(start, STEP)
            far = cells.distances(matrix(part.column("v"), dim), part.column("norm").to_numpy())
            classes = kind(part.column("label"))
            row, at = np.nonzero(needs(classes, far, of_cell[far.argmin(1)]))
            times = cells.parts[at]
            group = np.repeat(cells.first[at], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row = np.repeat(row, times)
            yield row + start, group * KINDS + classes[row] if by_kind else group

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, units in goals(batch):
            unit, n = np.unique(units, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(n)], ["unit", "n"])

    found = map_arrow(items, count, "unit long, n long").groupBy("unit").agg(F.sum("n").alias("n")).collect()
    slices = {r.unit: -(-r.n // rows) for r in found}

    def route(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        mixed = mix(batch.column("vec_id").to_numpy().astype(np.uint64))
        for row, units in goals(batch):
            ways = np.array([slices[u] for u in units.tolist()], np.uint64)
            slots = (mixed[row] % ways).astype(np.int64)
            for start in range(0, len(row), 10_000):
                some = slice(start, start + 10_000)
                pick = batch.take(pa.array(row[some])).select(["vec_id", "label", "v"])
                yield pa.RecordBatch.from_arrays([pa.array(units[some]), pa.array(slots[some]), *pick.columns], ["unit", "slice", "vec_id", "label", "v"])

    return map_arrow(items, route, "unit long, slice long, vec_id long, label string, v binary"), slices


def _copied(anchors: DataFrame, slices: dict[int, int]) -> DataFrame:
    """Anchors (unit, cls, label, v, ...) once for each slice of their unit."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        times = np.array([slices.get(u, 0) for u in batch.column("unit").to_pylist()], np.int64)
        row = np.repeat(np.arange(len(times)), times)
        slot = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        for start in range(0, len(row), 10_000):
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row[start : start + 10_000])).columns, pa.array(slot[start : start + 10_000])], [*batch.schema.names, "slice"])

    return map_arrow(anchors, run, f"{fields}, slice long")


def _joined(anchors: DataFrame, rows: DataFrame, slices: dict[int, int], dim: int, k: int, windowed: bool) -> DataFrame:
    """Exact join inside slices: (cls, way, vec_id, score, twin) of each anchor's k best rows of its label, or of other labels inside its windows (`lows`, `highs`)."""
    names = ["cls", "way", "vec_id", "score", "twin"]
    empty = pa.table({"cls": pa.array([], pa.int64()), "way": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "twin": pa.array([], pa.bool_())})

    def found(left: pa.Table, right: pa.Table, low: np.ndarray, high: np.ndarray, apart: tuple | None) -> pa.Table:
        ids = right["vec_id"].to_numpy()
        a, way, c, s = best(matrix(left["v"], dim), matrix(right["v"], dim), ids, k, low, high, apart)
        twin = pc.equal(left["v"].take(pa.array(a)), right["v"].take(pa.array(c)))
        return pa.Table.from_arrays([left["cls"].take(pa.array(a)), pa.array(way), pa.array(ids[c]), pa.array(s), twin], names)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        codes = pa.chunked_array([*left["label"].chunks, *right["label"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        mine, theirs = codes[: left.num_rows], codes[left.num_rows :]
        if windowed:
            ways = max(map(len, left["lows"].to_pylist()))
            low, high = (np.array([x + [fill] * (ways - len(x)) for x in left[c].to_pylist()], float) for c, fill in (("lows", math.inf), ("highs", -math.inf)))
            return found(left, right, low, high, (mine, theirs))
        out = [empty]
        for code in np.intersect1d(mine, theirs):
            some, others = left.filter(pa.array(mine == code)), right.filter(pa.array(theirs == code))
            out.append(found(some, others, np.full((some.num_rows, 1), -math.inf), np.full((some.num_rows, 1), math.inf), None))
        return pa.concat_tables(out)

    both = _copied(anchors, slices).groupBy("unit", "slice").cogroup(rows.groupBy("unit", "slice"))
    return both.applyInArrow(run, "cls long, way long, vec_id long, score long, twin boolean")


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows of each key, with `rank`."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame, vec: str = "embedding", vec_id: str = "vec_id", label: str = "label", every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
    pivots: int = PIVOTS, group: int | None = None, rows: int | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. `group` and `rows`: anchors of a group and rows of a slice, else chosen by the table's size up to GROUP and ROWS."""
    spark = df.sparkSession
    with scratch() as keep:
        given = materialize(scaled(df, vec, vec_id, label, scale).distinct(), "vectors")
        alike = Window.partitionBy("v", "label").orderBy("vec_id")
        items = materialize(given.withColumn("nth", F.row_number().over(alike)).where(F.col("nth") <= positives + 1).drop("nth"), "items")
        anchors = keep(materialize(given.where(F.col("vec_id") % every == 0).select("vec_id", "label", "v", "norm"), "anchors"))
        classes = materialize(anchors.groupBy("v", "label").agg(F.max("norm").alias("norm")).withColumn("cls", F.monotonically_increasing_id()), "classes")
        n, top, size = items.agg(F.count("*"), F.max("norm"), F.max(F.length("v"))).first()
        asked = classes.count()
        if not n or not asked:
            return spark.createDataFrame([], RESULT)
        dim, group, rows = max(1, size // 4), group or min(GROUP, max(256, asked // 32)), rows or min(ROWS, max(4096, n // 64))
        picked = items.orderBy(F.xxhash64("v"), "v").limit(min(pivots, math.ceil(math.sqrt(n)))).select("v").collect()
        cells = Cells(matrix(pa.array([bytes(r.v) for r in picked], pa.binary()), dim), float(top), *(np.zeros(0, np.int64) for _ in range(3)))
        placed = materialize(_placed(classes, cells, dim), "placed")
        counts = np.zeros(len(picked), np.int64)
        for r in placed.groupBy("pivot").agg(F.count("*").alias("n")).collect():
            counts[r.pivot] = r.n
        cells, cell_of = grouped(cells.pivots, counts, float(top), group)
        placed = _with_groups(placed, cells, cell_of)
        slack = 1e-6 * float(top) + 1

        # Positives: at home first, then wherever the bounds allow.
        radius, long, there = _stats(placed, cells, cell_of, {"radius": F.max("far"), "long": F.max("norm"), "n": F.count("*")}, True)
        known = there > 0
        at_bin = np.logical_or.reduceat(known, cells.starts, axis=1)

        def home(classes: np.ndarray, far: np.ndarray, bins: np.ndarray) -> np.ndarray:
            out = np.zeros((len(far), at_bin.shape[1]), bool)
            out[np.arange(len(far)), bins] = at_bin[classes, bins]
            return out

        routes, slices = routed(items, cells, home, True, dim, rows)
        units = placed.withColumn("unit", F.col("group") * KINDS + F.col("kind"))
        near = materialize(_joined(units.select("unit", "cls", "label", "v"), routes, slices, dim, positives + 1, False), "home")
        near = materialize(_first(near, ["cls"], positives + 1).drop("rank"), "near")
        reached = near.groupBy("cls").agg(F.when(F.count("*") > positives, F.min("score")).alias("reached"))
        (theta,) = _stats(placed.join(reached, "cls", "left"), cells, cell_of, {"theta": F.min(F.coalesce(F.col("reached").cast("double"), F.lit(float("-inf"))))}, True)
        starts = cells.starts

        def others(classes: np.ndarray, far: np.ndarray, bins: np.ndarray) -> np.ndarray:
            most = (long[classes] + top - np.maximum(0.0, far - radius[classes]) ** 2) / 2
            out = np.logical_or.reduceat(known[classes] & (most + slack >= theta[classes]), starts, axis=1)
            out[np.arange(len(far)), bins] = False
            return out

        routes, slices = routed(items, cells, others, True, dim, rows)
        away = _joined(units.select("unit", "cls", "label", "v"), routes, slices, dim, positives + 1, False)
        firsts = _first(near.unionByName(away), ["cls"], positives + 1)
        found = materialize(firsts.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score", "twin"))).alias("first")), "positives")

        # Negatives: wherever scores may lie in the windows of an anchor.
        scores = F.array_distinct(F.col("first.score"))
        lows, highs = F.transform(scores, lambda s: _floored(low * s + 99)), F.transform(scores, lambda s: _floored(high * s))
        wanted = materialize(placed.join(found, "cls").withColumns({"scores": scores, "lows": lows, "highs": highs, "unit": F.col("group")}).drop("first"), "windows")
        wide, short, length, floor, ceiling = _stats(wanted, cells, cell_of, {"wide": F.max("far"), "short": F.min("norm"), "length": F.max("norm"), "floor": F.min(F.array_min("lows")).cast("double"), "ceiling": F.max(F.array_max("highs")).cast("double")}, False)

        def in_windows(classes: np.ndarray, far: np.ndarray, bins: np.ndarray) -> np.ndarray:
            most, least = (length + top - np.maximum(0.0, far - wide) ** 2) / 2, (short + top - (far + wide) ** 2) / 2
            with np.errstate(invalid="ignore"):
                return np.logical_or.reduceat((most + slack >= floor) & (least - slack <= ceiling), starts, axis=1)

        routes, slices = routed(items, cells, in_windows, False, dim, rows)
        hard = _joined(wanted.select("unit", "cls", "label", "v", "lows", "highs"), routes, slices, dim, negatives, True)
        hard = _first(hard, ["cls", "way"], negatives).groupBy("cls").agg(F.collect_list(F.struct("way", "rank", "vec_id", "score")).alias("hard"))
        answers = keep(materialize(wanted.select("cls", "label", "v", "scores").join(found, "cls").join(hard, "cls").select("label", "v", "scores", "first", "hard"), "answers"))
    return _answered(anchors, answers, positives)


def _floored(x: Column) -> Column:
    """floor(x / 100) of integers."""
    return ((x - F.pmod(x, F.lit(100))) / 100).cast("long")


def _placed(classes: DataFrame, cells: Cells, dim: int) -> DataFrame:
    """Anchors with their pivot, the distance to it and the class of their label."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start in range(0, batch.num_rows, STEP):
            part = batch.slice(start, STEP)
            at, far = cells.of_anchors(matrix(part.column("v"), dim), part.column("norm").to_numpy())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at), pa.array(far), pa.array(kind(part.column("label")))], [*part.schema.names, "pivot", "far", "kind"])

    return map_arrow(classes.select("cls", "label", "v", "norm"), run, "cls long, label string, v binary, norm double, pivot long, far double, kind long")


def _with_groups(placed: DataFrame, cells: Cells, cell_of: np.ndarray) -> DataFrame:
    """`placed` with each anchor's group."""
    bins = np.where(cell_of >= 0, cells.bin[np.maximum(cell_of, 0)], 0)
    first, parts = (F.element_at(F.split(F.lit(",".join(map(str, x[bins].tolist()))), ",").cast("array<bigint>"), (F.col("pivot") + 1).cast("int")) for x in (cells.first, cells.parts))
    return placed.withColumn("group", first + F.pmod(F.xxhash64("cls"), parts))


def _stats(placed: DataFrame, cells: Cells, cell_of: np.ndarray, columns: dict[str, Column], by_kind: bool) -> tuple[np.ndarray, ...]:
    """Arrays of aggregates over each cell's anchors, by class of labels too where asked: (classes x) cells. Without anchors: nan, which no bound passes."""
    keys = ["kind", "pivot"] if by_kind else ["pivot"]
    out = [np.full((KINDS, len(cells.pivots)) if by_kind else len(cells.pivots), math.nan) for _ in columns]
    for r in placed.groupBy(*keys).agg(*(c.alias(k) for k, c in columns.items())).collect():
        at = (r.kind, cell_of[r.pivot]) if by_kind else cell_of[r.pivot]
        for x, k in zip(out, columns, strict=True):
            x[at] = math.nan if r[k] is None else r[k]
    return tuple(out)


def _answered(anchors: DataFrame, answers: DataFrame, positives: int) -> DataFrame:
    """The answers of a class of equal anchors for each of them: all its first rows but itself."""
    mine = F.filter("first", lambda p: ~(p["twin"] & (p["vec_id"] == F.col("anchor_id"))))
    rows = anchors.select(F.col("vec_id").alias("anchor_id"), "label", "v").join(answers, ["label", "v"])
    rows = rows.select("anchor_id", "scores", "hard", F.explode(F.slice(mine, 1, positives)).alias("p"))
    rows = rows.select("anchor_id", "p", F.explode(F.filter("hard", lambda h: F.element_at("scores", (h["way"] + 1).cast("int")) == F.col("p.score"))).alias("h"))
    fields = {"anchor_id": "anchor_id", "positive_id": "p.vec_id", "rank": "h.rank", "negative_id": "h.vec_id", "positive_score": "p.score", "negative_score": "h.score"}
    return rows.select(*(F.col(c).alias(k) for k, c in fields.items()))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", label.alias("label")))


OP11_SQL = """
WITH items AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM items a JOIN items b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positive AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), negative AS (
    SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM positive JOIN scored USING (anchor_id)
    WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT * FROM negative WHERE rank <= 3
"""
