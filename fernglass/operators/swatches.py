"""Legend swatches: coloured regions of a swatch's shape, in reading order, joined with near ones of their colour."""

from __future__ import annotations

from heapq import heapify, heappop, heappush
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernglass.functions import colour
from fernglass.operators import tiles
from fernglass.operators.components import checkpointed, tasks
from fernglass.operators.selection import order_statistics

LEAST_SIDE, LEAST_PIXELS, MOST_SHARE, MOST_ASPECT, LEAST_FILL = 12, 80, 0.12, 4, 0.35
ROW, NEAR, NEAR_COLOUR = 30, 10, 50


def shaped(blobs: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Regions of a swatch's shape and colour; sizes has (image_id, width, height), unless the regions have these already, which then stay."""
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    most = F.least("width", "height") * MOST_SHARE
    out = (blobs if sizes is None else blobs.join(sizes, "image_id")).where((w >= LEAST_SIDE) & (h >= LEAST_SIDE) & ~((w > most) & (h > most)) & (F.col("size") >= LEAST_PIXELS))
    out = out.where((F.greatest(w, h) / F.nullif(F.least(w, h), F.lit(0)) <= MOST_ASPECT) & (F.col("size") / F.nullif(w * h, F.lit(0)) >= LEAST_FILL))
    mean = F.col("cr"), F.col("cg"), F.col("cb")
    out = out.where(~colour.grayish(*mean) & ~colour.blue_gray(*mean))
    return out if sizes is None else out.drop("width", "height")


def ordered(swatches: DataFrame, row: int = ROW) -> DataFrame:
    """With `idx` from 0: by rows of `row` pixels, then from the left; ties by top and blob_id."""
    by = Window.partitionBy("image_id").orderBy(F.floor(F.col("min_y") / row), "min_x", "min_y", "blob_id")
    return swatches.withColumn("idx", F.row_number().over(by) - 1)


class Cells:
    """Swatches by colour (cubes of NEAR_COLOUR) and place, each in a grid of its own size class, so that it stands in four cells at most."""

    def __init__(self, items: list[tuple], gone: set[int]):
        self.gone = gone
        self.grids: dict[tuple, dict[int, dict[int, dict[int, list[int]]]]] = {}  # by colour, size class, column and row
        for i, (_, _, cr, cg, cb, x0, x1, y0, y1) in enumerate(items):
            level = max(4, int(max(x1 - x0, y1 - y0)).bit_length())
            columns = self.grids.setdefault((cr // NEAR_COLOUR, cg // NEAR_COLOUR, cb // NEAR_COLOUR), {}).setdefault(level, {})
            for cx in range(x0 >> level, (x1 >> level) + 1):
                for cy in range(y0 >> level, (y1 >> level) + 1):
                    columns.setdefault(cx, {}).setdefault(cy, []).append(i)

    def near(self, tint: tuple, box: tuple, before: tuple | None) -> list[int]:
        """Swatches of colours that may be near enough in the cells that the box touches, but for those that it touched before it grew."""
        out = []
        for at in product(*((t - 1, t, t + 1) for t in tint)):
            for level, columns in self.grids.get(at, {}).items():
                x0, x1, y0, y1 = (v >> level for v in box)
                if before is None:
                    parts = [(x0, x1, y0, y1)]
                else:
                    u0, u1, v0, v1 = (v >> level for v in before)
                    parts = [(x0, u0 - 1, y0, y1), (u1 + 1, x1, y0, y1), (u0, u1, y0, v0 - 1), (u0, u1, v1 + 1, y1)]
                for low_x, high_x, low_y, high_y in parts:
                    if low_x <= high_x and low_y <= high_y:
                        for cx in _among(columns, low_x, high_x):
                            rows = columns[cx]
                            for cy in _among(rows, low_y, high_y):
                                rows[cy] = [j for j in rows[cy] if j not in self.gone]
                                out += rows[cy]
        return out


def _among(there: dict[int, object], low: int, high: int) -> list[int]:
    """Keys from low to high, by whichever is shorter: the range or the keys."""
    return [k for k in range(low, high + 1) if k in there] if high - low < len(there) else [k for k in there if low <= k <= high]


FEW = 32


def merged_in_order(items: list[tuple]) -> list[tuple]:
    """The fold of `merge_near` over one image's swatches (idx, size, cr, cg, cb, min_x, max_x, min_y, max_y), in order."""
    return _merged_few(items) if len(items) <= FEW else _merged_by_cells(items)


def _merged_few(items: list[tuple]) -> list[tuple]:
    """A few swatches, each compared with all later ones."""
    waiting, out = items, []
    while waiting:
        (idx, size, cr, cg, cb, x0, x1, y0, y1), rest, waiting = waiting[0], waiting[1:], []
        for item in rest:
            _, more, r, g, b, u0, u1, v0, v1 = item
            if x0 - NEAR <= u1 and x1 + NEAR >= u0 and y0 - NEAR <= v1 and y1 + NEAR >= v0 and (cr - r) ** 2 + (cg - g) ** 2 + (cb - b) ** 2 <= NEAR_COLOUR**2:
                size += more
                x0, x1, y0, y1 = min(x0, u0), max(x1, u1), min(y0, v0), max(y1, v1)
            else:
                waiting.append(item)
        out.append((idx, size, cr, cg, cb, x0, x1, y0, y1))
    return out


def _apart(items: list[tuple]) -> list[list[tuple]]:
    """Swatches in order, by what is between rows without any that no box grows over."""
    out, below = [], None
    for item in sorted(items, key=lambda s: s[7]):
        if below is None or item[7] > below + NEAR:
            out.append([])
            below = item[8]
        out[-1].append(item)
        below = max(below, item[8])
    return [sorted(part) for part in out]


def _merged_by_cells(items: list[tuple]) -> list[tuple]:
    used: set[int] = set()
    cells, out = Cells(items, used), []
    for i, (idx, size, cr, cg, cb, x0, x1, y0, y1) in enumerate(items):
        if i in used:
            continue
        used.add(i)  # it can't be taken by a later one
        tint = cr // NEAR_COLOUR, cg // NEAR_COLOUR, cb // NEAR_COLOUR
        box = x0 - NEAR, x1 + NEAR, y0 - NEAR, y1 + NEAR
        waiting = [j for j in cells.near(tint, box, None) if j > i]
        heapify(waiting)
        at = i
        while waiting:
            j = heappop(waiting)
            if j <= at or j in used:
                continue
            at = j
            _, more, r, g, b, u0, u1, v0, v1 = items[j]
            if (cr - r) ** 2 + (cg - g) ** 2 + (cb - b) ** 2 <= NEAR_COLOUR**2 and x0 - NEAR <= u1 and x1 + NEAR >= u0 and y0 - NEAR <= v1 and y1 + NEAR >= v0:
                used.add(j)
                size += more
                if u0 < x0 or u1 > x1 or v0 < y0 or v1 > y1:
                    x0, x1, y0, y1 = min(x0, u0), max(x1, u1), min(y0, v0), max(y1, v1)
                    before, box = box, (x0 - NEAR, x1 + NEAR, y0 - NEAR, y1 + NEAR)
                    for k in cells.near(tint, box, before):
                        if k > j:
                            heappush(waiting, k)
        out.append((idx, size, cr, cg, cb, x0, x1, y0, y1))
    return out


MERGED = "idx long, size long, cr long, cg long, cb long, min_x long, max_x long, min_y long, max_y long"


#: About as many swatches of an image are folded together, where rows without any part them.
PART = 4096


def merge_near(swatches: DataFrame, also: tuple[str, ...] = (), part: int = PART) -> DataFrame:
    """One pass in order: a swatch takes each later free one of a colour within 50 whose box is within 10 pixels of its
    growing box. Colours stay the first's; sizes add up. The fold is in order; each looks only at those in the cells that its box touches as it grows.

    No box grows over more than 10 rows without a swatch, so an image is cut at such rows into parts of about `part` swatches, which are folded by themselves; what has no such rows stays together.
    Columns `also`, whole numbers that an image's swatches share, stay."""
    names = [f.split()[0] for f in MERGED.split(", ")]
    kind = swatches.schema["image_id"].dataType.simpleString()

    def run(found: pa.Table) -> pa.Table:
        items = [item for part in _apart(list(zip(*(found[n].to_pylist() for n in names), strict=True))) for item in merged_in_order(part)]
        shared = {n: pa.repeat(found[n][0], len(items)) for n in ("image_id", *also)}
        return pa.table(shared | {n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*items, strict=True), strict=True)})

    rows = swatches.select("image_id", *(F.col(n).cast("long").alias(n) for n in (*also, *names)))
    down = Window.partitionBy("image_id").orderBy("min_y", "idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"at_": F.row_number().over(Window.partitionBy("image_id").orderBy("min_y", "idx")), "above_": F.max("max_y").over(down.rowsBetween(Window.unboundedPreceding, -1))})
    rows = rows.withColumn("part_", F.floor(F.max(F.when(F.col("above_").isNull() | (F.col("min_y") > F.col("above_") + NEAR), F.col("at_"))).over(down) / part)).drop("at_", "above_")
    dealt = rows.repartition(tasks(swatches.sparkSession), "image_id", "part_")
    return dealt.groupBy("image_id", "part_").applyInArrow(run, ", ".join([f"image_id {kind}", *(f"{c} long" for c in also), MERGED]))


def size_fence(rows: DataFrame, key: str = "image_id", area: str = "area") -> DataFrame:
    """Rows whose area lies between 0.05 first quartiles and 20 third quartiles of their key's; fewer than 5 rows all stay.

    Quartiles are the items at floor(n / 4) and floor(3 n / 4) of the sorted areas (whole numbers), from 0. Null areas don't count, and stay only where all do."""
    names = {c: f"__fence_{c}" for c in ("key", "n", "low", "high")}
    found = order_statistics(rows, key, area, {names["low"]: 0.25, names["high"]: 0.75}).withColumnsRenamed({key: names["key"], "n_": names["n"]})
    fenced = rows.join(found, F.col(key).eqNullSafe(F.col(names["key"])), "left")
    stays = (F.coalesce(names["n"], F.lit(0)) < 5) | F.col(area).between(F.col(names["low"]) * 0.05, F.col(names["high"]) * 20)
    return fenced.where(stays).drop(*names.values())


def detect(images: DataFrame, sized: bool = False) -> DataFrame:
    """The swatches of images, given as tiles: (image_id, idx, cr, cg, cb, size, min_x, max_x, min_y, max_y), with the image's width and height if `sized`.

    Tiles are gone through once, as regions bring their image's size."""
    found = ordered(shaped(tiles.mask_regions(images, tiles.coloured, sized=True)))
    one = checkpointed(merge_near(found, ("width", "height") if sized else ())).withColumn("area", (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")))
    return size_fence(one).drop("area")
