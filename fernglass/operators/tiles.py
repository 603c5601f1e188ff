"""Rasters as tiles: masks, measures, regions, samples and template windows by numpy over square parts of an image, without a row for each pixel.

A tile row is (image_id, ty, tx, y0, x0, h, w, width, height, planes): its place among the image's tiles, its corner, its size, the image's size and the red, green,
blue and alpha bytes, one plane after the other, each by rows. Tiles are `side` wide and high, but for the last ones of an image. A task holds one tile
and what it finds there, and an image of any size is spread over as many tasks as it has tiles.

* **Colours.** A palette of up to 10,000 colours goes to all tasks. A tile's different colours are looked up in a grid of cells over red, green and blue: a cell keeps the
  palette's colours that lie within the tolerance of any of its points, found at its first use, and only these are compared. So a pixel costs no more
  than the colours that are near it, and equal pixels are compared once.
* **Regions.** Runs of rows are joined inside a tile. A tile sends a row for each of its regions, with sums, and the pixels on its border; those meet
  the next tile's border pixels by image, colour and place (an equi join), and only regions that touch a border spread their labels in rounds.
* **Windows.** Sums over rectangles are four lookups each in a tile's summed-area tables. A window that crosses tiles is cut into a part for each, and sums of
  parts are added. The tables hold whole numbers, so that a flat window has a variance of exactly 0.

Rows with null planes are left out; empty tables give empty results. image_id may be of any type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernglass.functions import colour
from fernglass.operators import raster
from fernglass.operators import templates as patterns
from fernglass.operators.components import checkpointed, components, dealt, tasks

SIDE = 256
FIELDS = "ty int, tx int, y0 long, x0 long, h int, w int, width int, height int, planes binary"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
MOST_COLOURS = 10_000
#: Pixels with their colours that are held at a time inside a tile.
HELD = 1 << 21
_ROW = 1 << 24

Arrays = dict[str, "np.ndarray | pa.Array"]


def _each(tiles: DataFrame, f: Callable[[np.ndarray, int, int], Iterator[Arrays]], fields: str) -> DataFrame:
    """image_id and `fields` that f makes of each tile's planes (4 x h x w) and corner (y0, x0)."""
    kind, names = tiles.schema["image_id"].dataType.simpleString(), [x.split()[0] for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                y0, x0, h, w = (batch.column(k)[i].as_py() for k in range(1, 5))
                planes = np.frombuffer(batch.column(5)[i].as_buffer(), np.uint8).reshape(4, h, w)
                for found in f(planes, y0, x0):
                    columns = [c if isinstance(c, pa.Array) else pa.array(c) for c in (found[n] for n in names)]
                    if len(columns[0]):
                        yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], len(columns[0])), *columns], ["image_id", *names])

    return tiles.where("planes is not null").select("image_id", "y0", "x0", "h", "w", "planes").mapInArrow(run, f"image_id {kind}, {fields}")


def image_sizes(tiles: DataFrame) -> DataFrame:
    """(image_id, width, height); planes are not read."""
    return tiles.groupBy("image_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))


def cut(planes: np.ndarray, side: int = SIDE, top: int = 0, height: int | None = None) -> Iterator[tuple]:
    """Tiles (values of FIELDS) of an array (4 x rows x width) whose first row is row `top` of the image, a multiple of `side`."""
    for y in range(0, planes.shape[1], side):
        for x in range(0, planes.shape[2], side):
            part = np.ascontiguousarray(planes[:, y : y + side, x : x + side])
            yield (top + y) // side, x // side, top + y, x, part.shape[1], part.shape[2], planes.shape[2], height or planes.shape[1], part.tobytes()


def batch_of(image: pa.Scalar, rows: list[tuple]) -> pa.RecordBatch:
    """Tiles of an image as a batch."""
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = [pa.array(c, types[f.split()[1]]) for c, f in zip(zip(*rows, strict=True), FIELDS.split(", "), strict=True)]
    return pa.RecordBatch.from_arrays([pa.repeat(image, len(rows)), *columns], ["image_id", *NAMES])


def pixels(tiles: DataFrame) -> DataFrame:
    """A row for each pixel, for operators that ask for such."""

    def rows(planes: np.ndarray, y0: int, x0: int) -> Iterator[Arrays]:
        h, w = planes.shape[1:]
        yield {"y": np.repeat(np.arange(y0, y0 + h), w), "x": np.tile(np.arange(x0, x0 + w), h), **{c: planes[k].ravel().astype(np.int32) for k, c in enumerate("rgba")}}

    return _each(tiles, rows, "y long, x long, r int, g int, b int, a int")


def of_pixels(pixels: DataFrame, side: int = SIDE) -> DataFrame:
    """Pixel rows (image_id, y, x, r, g, b, a) as tiles; places without a row are clear."""
    kind = pixels.schema["image_id"].dataType.simpleString()
    sized = pixels.join(raster.image_sizes(pixels), "image_id").withColumns({"ty": F.floor(F.col("y") / side).cast("int"), "tx": F.floor(F.col("x") / side).cast("int")})

    def tile(found: pa.Table) -> pa.Table:
        ty, tx, width, height = (found[c][0].as_py() for c in ("ty", "tx", "width", "height"))
        h, w = min(side, height - ty * side), min(side, width - tx * side)
        planes = np.zeros((4, h, w), np.uint8)
        y, x = found["y"].to_numpy() - ty * side, found["x"].to_numpy() - tx * side
        for k, c in enumerate("rgba"):
            planes[k, y, x] = found[c].to_numpy()
        return pa.Table.from_batches([batch_of(found["image_id"][0], [(ty, tx, ty * side, tx * side, h, w, width, height, planes.tobytes())])])

    rows = sized.select("image_id", "ty", "tx", *(F.col(c).cast("int").alias(c) for c in ("y", "x", "r", "g", "b", "a", "width", "height")))
    return rows.groupBy("image_id", "ty", "tx").applyInArrow(tile, f"image_id {kind}, {FIELDS}")


# Measures


def _shade(planes: np.ndarray) -> np.ndarray:
    return (planes[0].astype(np.int32) + planes[1] + planes[2]) / 3.0


def _extreme(planes: np.ndarray) -> np.ndarray:
    return (planes[:3] > 240).all(0) | (planes[:3] < 15).all(0)


def measures(tiles: DataFrame, to: tuple[int, int, int]) -> DataFrame:
    """A row for each pixel with its distance from a colour, brightness, saturation, spread and luminance, and what kinds it belongs to."""

    def rows(planes: np.ndarray, y0: int, x0: int) -> Iterator[Arrays]:
        h, w = planes.shape[1:]
        r, g, b = (planes[k].ravel().astype(np.int64) for k in range(3))
        high, low, shade = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b), (r + g + b) / 3.0
        saturation = np.divide(high - low, high, out=np.zeros(len(r)), where=high > 0)
        spread = np.maximum(np.maximum(np.abs(r - g), np.abs(g - b)), np.abs(r - b))
        blue_gray = (b > g) & (g > r) & (r >= 100) & (r <= 125) & (g >= 130) & (g <= 150) & (b >= 165) & (b <= 185) & (saturation < 0.35)
        yield {
            "y": np.repeat(np.arange(y0, y0 + h), w), "x": np.tile(np.arange(x0, x0 + w), h), "distance": np.sqrt(((r - to[0]) ** 2 + (g - to[1]) ** 2 + (b - to[2]) ** 2).astype(float)), "brightness": shade, "saturation": saturation,
            "spread": spread, "luminance": 0.299 * r + 0.587 * g + 0.114 * b, "coloured": (shade > 30) & (shade < 240) & (spread > 10) & ~blue_gray, "blue_gray": blue_gray, "inked": (shade > 20) & (shade < 240),
            "grayish": (high - low < 15) & (high > 50) & (high < 220), "extreme": _extreme(planes).ravel(),
        }

    return _each(tiles, rows, "y long, x long, distance double, brightness double, saturation double, spread long, luminance double, coloured boolean, blue_gray boolean, inked boolean, grayish boolean, extreme boolean")


def coloured(planes: np.ndarray) -> np.ndarray:
    """Which pixels are coloured, as `colour.coloured` tells. Gray ones, most of a plan's, are not, and are looked at no further."""
    out = ((planes[0] != planes[1]) | (planes[1] != planes[2])).ravel()
    some = np.flatnonzero(out)
    tints = np.stack([planes[k].ravel()[some] for k in range(3)])
    r, g, b = tints.astype(np.int64)
    high, low, shade = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b), _shade(tints)
    saturation = np.divide(high - low, high, out=np.zeros(high.shape), where=high > 0)
    text = (b > g) & (g > r) & (r >= 100) & (r <= 125) & (g >= 130) & (g <= 150) & (b >= 165) & (b <= 185) & (saturation < 0.35)
    out[some] = (shade > 30) & (shade < 240) & (high - low > 10) & ~text
    return out.reshape(planes.shape[1:])


def mean_colours(tiles: DataFrame) -> DataFrame:
    """(image_id, n, cr, cg, cb): pixels and their rounded mean."""

    def sums(planes: np.ndarray, y0: int, x0: int) -> Iterator[Arrays]:
        yield {"n": [planes[0].size], **{f"s{c}": [int(planes[k].sum(dtype=np.int64))] for k, c in enumerate("rgb")}}

    parts = _each(tiles, sums, "n long, sr long, sg long, sb long").groupBy("image_id").agg(F.sum("n").alias("n"), *(F.sum(f"s{c}").alias(f"s{c}") for c in "rgb"))
    return parts.select("image_id", "n", *(colour.rounded(F.col(f"s{c}") / F.col("n")).alias(f"c{c}") for c in "rgb"))


def row_shares(tiles: DataFrame, kind: Callable[[np.ndarray], np.ndarray] = lambda planes: (_shade(planes) > 20) & (_shade(planes) < 240)) -> DataFrame:
    """(image_id, y, density): the share of each row's pixels of a kind (planes to a mask); by default those that are neither paper nor ink-black."""

    def counts(planes: np.ndarray, y0: int, x0: int) -> Iterator[Arrays]:
        h, w = planes.shape[1:]
        yield {"y": np.arange(y0, y0 + h), "hits": kind(planes).sum(1, dtype=np.int64), "n": np.full(h, w, np.int64)}

    return _each(tiles, counts, "y long, hits long, n long").groupBy("image_id", "y").agg((F.sum("hits") / F.sum("n")).alias("density"))


def row_sums(tiles: DataFrame, share: float = 0.35) -> DataFrame:
    """(image_id, y, width, height, density, n, sr, sg, sb): what `row_shares` and `swatch_sums` find, in one pass, with the image's size; n may be 0."""
    kind = tiles.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                y0, x0, h, w, width, height = (batch.column(k)[i].as_py() for k in range(1, 7))
                planes = np.frombuffer(batch.column(7)[i].as_buffer(), np.uint8).reshape(4, h, w)
                shade, part = _shade(planes), max(0, int(width * share) - x0)
                hit = (shade[:, :part] <= 225) & (shade[:, :part] >= 30)
                sums = [(planes[k, :, :part] * hit).sum(1, dtype=np.int64) for k in range(3)]
                columns = np.arange(y0, y0 + h), np.full(h, width, np.int32), np.full(h, height, np.int32), ((shade > 20) & (shade < 240)).sum(1, dtype=np.int64), np.full(h, w, np.int64), hit.sum(1, dtype=np.int64), *sums
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], h), *map(pa.array, columns)], ["image_id", *(f.split()[0] for f in fields.split(", "))])

    fields = "y long, width int, height int, inked long, wide long, n long, sr long, sg long, sb long"
    rows = tiles.where("planes is not null").select("image_id", "y0", "x0", "h", "w", "width", "height", "planes").mapInArrow(run, f"image_id {kind}, {fields}")
    sums = rows.groupBy("image_id", "y").agg(F.max("width").alias("width"), F.max("height").alias("height"), (F.sum("inked") / F.sum("wide")).alias("density"), *(F.sum(c).alias(c) for c in ("n", "sr", "sg", "sb")))
    return sums


def swatch_sums(tiles: DataFrame, share: float = 0.35) -> DataFrame:
    """(image_id, y, n, sr, sg, sb): sums over each row's swatch pixels, in the left `share` of the image and neither paper nor ink; see `raster.colours_of_bands`."""
    return row_sums(tiles, share).select("image_id", "y", "n", "sr", "sg", "sb").where("n > 0")


def highlighted(tiles: DataFrame, target: tuple[int, int, int], tolerance: int = raster.TOLERANCE, paint: tuple[int, int, int, int] = (255, 255, 0, 140)) -> DataFrame:
    """Tiles of an overlay: `paint` where a pixel matches, clear elsewhere."""
    kind = tiles.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                planes = np.frombuffer(batch.column("planes")[i].as_buffer(), np.uint8).reshape(4, batch.column("h")[i].as_py(), -1).astype(np.int32)
                hit = (planes[3] >= 128) & (sum((planes[k] - target[k]) ** 2 for k in range(3)) < tolerance * tolerance)
                over = (np.array(paint, np.uint8)[:, None, None] * hit).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns[:-1]), pa.array([over.tobytes()], pa.binary())], batch.schema.names)

    return tiles.where("planes is not null").select("image_id", *NAMES).mapInArrow(run, f"image_id {kind}, {FIELDS}")


# Colours


class Grid:
    """A palette's colours by cells of red, green and blue, `step` wide; a cell's list is made when it is asked for first."""

    def __init__(self, ids: np.ndarray, rgb: np.ndarray, tolerance: int):
        self.ids, self.rgb, self.tolerance = ids, rgb.astype(np.int32), tolerance
        self.step = max(8, -(-tolerance // 2))
        self.near: dict[int, np.ndarray] = {}

    def cell(self, key: int) -> np.ndarray:
        """Colours nearer than the tolerance to some point of the cell, in order."""
        if key not in self.near:
            low = np.array([key >> 16, key >> 8 & 255, key & 255]) * self.step
            away = np.maximum(0, np.maximum(low - self.rgb, self.rgb - (low + self.step - 1)))
            self.near[key] = np.flatnonzero((away**2).sum(1) < self.tolerance**2)
        return self.near[key]

    def pairs(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(colour, place in `seen`) of all matches of different colours, given as r << 16 | g << 8 | b."""
        rgb = np.stack([seen >> 16, seen >> 8 & 255, seen & 255], 1).astype(np.int32)
        part = rgb // self.step
        keys = part[:, 0] << 16 | part[:, 1] << 8 | part[:, 2]
        order = np.argsort(keys, kind="stable")
        ends = np.flatnonzero(np.diff(keys[order], append=-1)) + 1
        colours, places, start = [], [], 0
        for end in ends.tolist():
            some, start = order[start:end], end
            near = self.cell(int(keys[some[0]]))
            each = max(1, HELD // max(1, len(near)))
            for at in range(0, len(some) if len(near) else 0, each):
                here = some[at : at + each]
                u, c = np.nonzero(((rgb[here, None] - self.rgb[None, near]) ** 2).sum(2) < self.tolerance**2)
                colours.append(near[c])
                places.append(here[u])
        empty = np.zeros(0, np.int64)
        return (np.concatenate(colours), np.concatenate(places)) if colours else (empty, empty)


def _palette(palette: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = palette.select("id", "r", "g", "b").limit(MOST_COLOURS + 1).collect()
    if len(rows) > MOST_COLOURS:
        raise ValueError(f"a palette has at most {MOST_COLOURS} colours")
    return np.array([r.id for r in rows], np.int64), np.array([[r.r, r.g, r.b] for r in rows], np.int32).reshape(-1, 3)


def _matches(planes: np.ndarray, grid: Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Matches (colour, place), and the opaque pixels by place: `pixel` holds their numbers, those of a place from starts[place] to starts[place + 1]."""
    opaque = np.flatnonzero(planes[3].ravel() >= 128)
    packed = planes[0].ravel()[opaque].astype(np.int64) << 16 | planes[1].ravel()[opaque].astype(np.int64) << 8 | planes[2].ravel()[opaque]
    order = np.argsort(packed, kind="stable")
    seen, first = np.unique(packed[order], return_index=True)
    return *grid.pairs(seen), opaque[order], np.append(first, len(opaque))


def _gridded(tiles: DataFrame, palette: DataFrame, tolerance: int, f: Callable[[np.ndarray, int, int, Grid], Iterator[Arrays]], fields: str) -> DataFrame:
    """`_each` with a grid of the palette, one for each task, under color_id of the palette's type."""
    ids, rgb = _palette(palette)
    held: list[Grid] = []

    def run(planes: np.ndarray, y0: int, x0: int) -> Iterator[Arrays]:
        if not held:
            held.append(Grid(ids, rgb, tolerance))
        return f(planes, y0, x0, held[0])

    kind = palette.schema["id"].dataType.simpleString()
    return _each(tiles, run, f"color_id long, {fields}").withColumn("color_id", F.col("color_id").cast(kind))


def match_counts(tiles: DataFrame, palette: DataFrame, tolerance: int = raster.TOLERANCE) -> DataFrame:
    """(image_id, color_id, matches) of the colours that an image shows."""

    def counts(planes: np.ndarray, y0: int, x0: int, grid: Grid) -> Iterator[Arrays]:
        colours, places, _, starts = _matches(planes, grid)
        n = np.bincount(colours, np.diff(starts)[places], len(grid.ids)).astype(np.int64)
        yield {"color_id": grid.ids[n > 0], "n": n[n > 0]}

    return _gridded(tiles, palette, tolerance, counts, "n long").groupBy("image_id", "color_id").agg(F.sum("n").alias("matches"))


# Regions


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes is connected to by edges (a, b)."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Lists of the values of owners 0..n."""
    order = np.argsort(owner, kind="stable")
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]), pa.int32()), pa.array(values[order], pa.int64()))


_REGION = "n long, sx long, sy long, sr long, sg long, sb long, min_x long, max_x long, min_y long, max_y long"


Sought = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _tile_regions(planes: np.ndarray, y0: int | np.ndarray, x0: int | np.ndarray, ids: np.ndarray, matches: Sought, stacked: bool = False) -> Iterator[Arrays]:
    """Regions of matches (see `_matches`) inside a tile: id (least y * 2^24 + x), sums, box, their pixels on the tile's border above and left (`heads`), and the places in the next tiles that those
    on its border below and right touch (`feet`, `sides`). `stacked`: planes (4 x tiles x h x w) of tiles of one size, each of which is a colour's, with corners by colour."""
    h, w = planes.shape[-2:]
    top, side = np.broadcast_to(y0, len(ids)), np.broadcast_to(x0, len(ids))
    colours, places, pixel, starts = matches
    order = np.argsort(colours, kind="stable")
    colours, places = colours[order], places[order]
    sizes = np.diff(starts)[places]
    # Whole colours at a time, as many as hold about HELD pixels.
    block = np.cumsum(sizes) // HELD
    firsts = np.flatnonzero(np.diff(colours, prepend=-1))
    block = np.repeat(block[firsts], np.diff(np.append(firsts, len(colours)))) if len(firsts) else block
    for some in (np.flatnonzero(block == k) for k in np.unique(block)):
        n = sizes[some]
        at = np.repeat(starts[places[some]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        key = np.sort(np.repeat(colours[some], n) * (h * w) + pixel[at])
        c, p = key // (h * w), key % (h * w)
        y, x = p // w, p % w
        head = np.flatnonzero((np.diff(key, prepend=-2) != 1) | (x == 0))
        tail = np.append(head[1:], len(key)) - 1
        rc, ry, left, right = c[head], y[head], x[head], x[tail]
        base, below = (rc * (h + 1) + ry) * (w + 2), (rc * (h + 1) + ry + 1) * (w + 2)
        low, high = np.searchsorted(base + right, below + left - 1), np.searchsorted(base + left, below + right + 1, "right")
        times = np.maximum(0, high - low)
        upper = np.repeat(np.arange(len(head)), times)
        root = connected(len(head), upper, np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum()))
        firsts, region = np.unique(root, return_inverse=True)
        k, run = len(firsts), np.repeat(np.arange(len(head)), tail - head + 1)
        sums = lambda v: np.bincount(region, v, k).astype(np.int64)
        total = lambda v: sums(np.add.reduceat(v, head))
        length = right - left + 1
        box = [np.full(k, big) for big in (_ROW, -1, _ROW, -1)]
        of = rc[firsts]
        fy, fx, seen = top[of], side[of], key if stacked else p
        for out, f, v in zip(box, (np.minimum, np.maximum) * 2, (left, right, ry, ry), strict=True):
            f.at(out, region, v)
        place = (y + top[c]) * _ROW + x + side[c]
        owner = region[run]
        edge = (y == 0) | (x == 0)

        def touched(mask: np.ndarray, along: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
            """Regions and the places along a border that are at most one from their pixels, each once."""
            both = np.unique((owner[mask] * (size + 2) + along[mask])[:, None] + np.arange(3))
            return both // (size + 2), both % (size + 2) - 1

        (low_of, low_x), (right_of, right_y) = touched(y == h - 1, x, w), touched(x == w - 1, y, h)
        yield {
            "color_id": ids[of], "at": of, "id": (ry[firsts] + fy) * _ROW + left[firsts] + fx, "n": sums(length), "sx": total(x) + fx * sums(length), "sy": total(y) + fy * sums(length),
            **{f"s{name}": total(planes[i].ravel()[seen].astype(np.int64)) for i, name in enumerate("rgb")}, "min_x": box[0] + fx, "max_x": box[1] + fx, "min_y": box[2] + fy, "max_y": box[3] + fy,
            "heads": _lists(owner[edge], place[edge], k), "feet": _lists(low_of, (fy[low_of] + h) * _ROW + fx[low_of] + low_x, k), "sides": _lists(right_of, (fy[right_of] + right_y) * _ROW + fx[right_of] + w, k),
        }


def regions(tiles: DataFrame, palette: DataFrame, tolerance: int = raster.TOLERANCE, least: int = raster.LEAST_SIZE) -> DataFrame:
    """8-connected regions of all palette colours, as `raster.regions` gives them of a mask."""
    return _joined(_gridded(tiles, palette, tolerance, lambda planes, y0, x0, grid: _tile_regions(planes, y0, x0, grid.ids, _matches(planes, grid)), _IN_TILE), least)


def mask_regions(tiles: DataFrame, kind: Callable[[np.ndarray], np.ndarray], least: int = 1, sized: bool = False) -> DataFrame:
    """8-connected regions of the pixels of a kind (planes to a mask, pixel by pixel), with color_id 0, and with the image's width and height if `sized`.

    Tiles of one size are looked at together, up to HELD / 32 pixels at a time, each as a colour of its own."""
    image, also = tiles.schema["image_id"].dataType.simpleString(), ["width", "height"] if sized else []
    fields = ", ".join([*(f"{c} int" for c in also), f"color_id long, {_IN_TILE}"])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y0, x0, h, w = (batch.column(c).to_numpy() for c in ("y0", "x0", "h", "w"))
            stored, shape = batch.column("planes"), h.astype(np.int64) << 32 | w
            for size in np.unique(shape).tolist():
                alike, (tall, wide) = np.flatnonzero(shape == size), (size >> 32, size & 0xFFFFFFFF)
                area = tall * wide
                each = max(1, HELD // 32 // max(1, area))
                for at in (alike[i : i + each] for i in range(0, len(alike), each)):
                    planes = np.stack([np.frombuffer(stored[i].as_buffer(), np.uint8).reshape(4, area) for i in at.tolist()], 1)
                    hit = np.flatnonzero(kind(planes.reshape(4, len(at) * tall, wide)))
                    ends = np.searchsorted(hit, np.arange(len(at) + 1) * area)
                    some = np.flatnonzero(np.diff(ends))
                    for found in _tile_regions(planes.reshape(4, len(at), tall, wide), y0[at], x0[at], np.zeros(len(at), np.int64), (some, some, hit % area, ends), True):
                        of = pa.array(at[found["at"]])
                        columns = [c if isinstance(c, pa.Array) else pa.array(c) for c in (found[name.split()[0]] for name in _IN_TILE.split(", "))]
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in ("image_id", *also)), pa.array(found["color_id"]), *columns], ["image_id", *(f.split()[0] for f in fields.split(", "))])

    found = tiles.where("planes is not null").select("image_id", *also, "y0", "x0", "h", "w", "planes").mapInArrow(inside, f"image_id {image}, {fields}")
    return _joined(found, least, also)


_IN_TILE = f"id long, {_REGION}, heads array<long>, feet array<long>, sides array<long>"


def _joined(found: DataFrame, least: int, also: list[str] | None = None) -> DataFrame:
    """Whole regions from those inside tiles, with columns `also` that an image's tiles share."""
    found = checkpointed(found)
    keyed = found.withColumn("key", F.struct("image_id", "color_id"))
    ends = keyed.select("key", F.col("id").alias("a"), F.explode(F.concat("feet", "sides")).alias("at"))
    heads = keyed.select("key", F.col("id").alias("b"), F.explode("heads").alias("at"))
    edges = ends.join(dealt(heads), ["key", "at"]).select(F.col("key").alias("image_id"), "a", "b").where("a != b").distinct()
    edges = checkpointed(edges)
    joined = keyed.withColumn("root", F.col("id"))
    if not edges.isEmpty():
        nodes = edges.select("image_id", F.col("a").alias("id")).unionByName(edges.select("image_id", F.col("b").alias("id"))).distinct()
        roots = components(nodes, edges).select(F.col("image_id").alias("key"), "id", F.col("root").alias("whole"))
        joined = keyed.join(dealt(roots), ["key", "id"], "left").withColumn("root", F.coalesce("whole", "id"))
    merged = joined.groupBy("key", "root").agg(
        *(F.sum(c).alias(c) for c in ("n", "sx", "sy", "sr", "sg", "sb")), F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"), F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"), *(F.max(c).alias(c) for c in also or ()),
    ).where(F.col("n") >= least)
    return merged.select(
        "key.image_id", "key.color_id", F.col("root").alias("blob_id"), (F.col("sx") / F.col("n")).alias("x"), (F.col("sy") / F.col("n")).alias("y"), F.col("n").alias("size"),
        *(colour.rounded(F.col(f"s{c}") / F.col("n")).alias(f"c{c}") for c in "rgb"), "min_x", "max_x", "min_y", "max_y", *(also or ()),
    )


def scan(tiles: DataFrame, palette: DataFrame, tolerance: int = raster.TOLERANCE, least: int = raster.LEAST_SIZE, floor: float = raster.LEAST_RADIUS, templates: DataFrame | None = None, threshold: float = patterns.THRESHOLD, side: int = SIDE) -> DataFrame:
    """The whole search, as `raster.scan` makes it over pixels."""
    found = raster.compact(raster.merged(regions(tiles, palette, tolerance, least), floor))
    if templates is None:
        return found.withColumn("pattern_score", F.lit(1.0))
    return scored(found, tiles, templates, threshold, side)


# Windows


def summed(values: np.ndarray) -> np.ndarray:
    """Summed-area table of whole numbers, with a row and a column of zeros before."""
    out = np.zeros((values.shape[0] + 1, values.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(values, 0, dtype=np.int64), 1, out=out[1:, 1:])
    return out


def boxed(table: np.ndarray, y0: np.ndarray, x0: np.ndarray, y1: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """Sums over boxes (ends exclusive): four lookups each."""
    return table[y1, x1] - table[y0, x1] - table[y1, x0] + table[y0, x0]


def _parts(boxes: DataFrame, side: int) -> DataFrame:
    """Boxes (image_id, x0, y0, x1, y1, ...; ends exclusive) once for each tile (ty, tx) that they touch."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / side), F.floor((F.col(b) - 1) / side)))
    rows = boxes.where("x1 > x0 and y1 > y0").withColumn("ty", span("y0", "y1")).withColumn("tx", span("x0", "x1"))
    return rows.withColumns({"ty": F.col("ty").cast("int"), "tx": F.col("tx").cast("int")})


def _in_tiles(tiles: DataFrame, parts: DataFrame, f: Callable[..., Arrays], fields: str) -> DataFrame:
    """What f makes of each tile's planes, the boxes in it, their ends (y0, x0, y1, x1) cut to the tile and in its own places, and the tile's corner. A tile meets all its boxes once.

    A tile's boxes come as a list, and the lists of a task are what its tiles are looked up in: tiles stream by, unsorted, and those without boxes are dropped before Python sees them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    names, keys = [x.split()[0] for x in fields.split(", ")], ["image_id", "ty", "tx"]
    schema = to_arrow_schema(_parse_datatype_string(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops, lefts, hs, ws = (batch.column(c).to_pylist() for c in ("y0", "x0", "h", "w"))
            lists, all_boxes = batch.column("boxes"), batch.column("boxes").values
            ends, out, n = lists.offsets.to_pylist(), [], 0
            for i, (top, x_left, h, w) in enumerate(zip(tops, lefts, hs, ws, strict=True)):
                right = pa.Table.from_batches([pa.RecordBatch.from_struct_array(all_boxes.slice(ends[i], ends[i + 1] - ends[i]))])
                planes = np.frombuffer(batch.column("planes")[i].as_buffer(), np.uint8).reshape(4, h, w)
                place = lambda c, corner, most: np.clip(right[c].to_numpy() - corner, 0, most)  # noqa: B023, E731
                found = f(planes, right, place("y0", top, h), place("x0", x_left, w), place("y1", top, h), place("x1", x_left, w), top, x_left)
                out.append(pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in (found[name] for name in names)], names).cast(schema))
                n += right.num_rows
                if n >= 1024 or i + 1 == len(tops):
                    yield from pa.concat_tables(out).combine_chunks().to_batches()
                    out, n = [], 0

    at, number = F.struct(*keys).alias("at_"), tasks(tiles.sparkSession)
    one = tiles.where("planes is not null").select(at, "y0", "x0", "h", "w", "planes").repartition(number, "at_")
    boxes = parts.select(at, F.struct(*(c for c in parts.columns if c not in ("ty", "tx"))).alias("box")).repartition(number, "at_").groupBy("at_").agg(F.collect_list("box").alias("boxes"))
    return one.join(boxes.hint("shuffle_hash"), "at_").select("y0", "x0", "h", "w", "planes", "boxes").mapInArrow(run, fields)


def sampled_colour(tiles: DataFrame, points: DataFrame, radius: int = 3, side: int = SIDE) -> DataFrame:
    """(point_id, cr, cg, cb) as `raster.sampled_colour` gives them, from summed-area tables."""
    corner = lambda c: F.greatest(F.lit(0), F.col(c) - radius).cast("long")
    whole = lambda c: F.col(c).cast("long").alias(c)
    boxes = points.select(whole("point_id"), "image_id", whole("px"), whole("py"), corner("px").alias("x0"), corner("py").alias("y0"))
    boxes = boxes.withColumns({"x1": F.col("x0") + 2 * radius + 1, "y1": F.col("y0") + 2 * radius + 1})

    def sums(planes: np.ndarray, rows: pa.Table, y0: np.ndarray, x0: np.ndarray, y1: np.ndarray, x1: np.ndarray, top: int, left: int) -> Arrays:
        plain = ~_extreme(planes)
        out = {"point_id": rows["point_id"].combine_chunks(), "n": boxed(summed(plain), y0, x0, y1, x1)}
        py, px = rows["py"].to_numpy() - top, rows["px"].to_numpy() - left
        here = (py >= 0) & (px >= 0) & (py < planes.shape[1]) & (px < planes.shape[2])
        for k, c in enumerate("rgb"):
            out[f"sum_{c}"] = boxed(summed(planes[k] * plain), y0, x0, y1, x1)
            out[f"own_{c}"] = pa.array(planes[k, np.where(here, py, 0), np.where(here, px, 0)].astype(np.int64), mask=~here)
        return out

    fields = ", ".join(["point_id long", "n long", *(f"{kind}_{c} long" for c in "rgb" for kind in ("sum", "own"))])
    rows = _in_tiles(tiles, _parts(boxes, side), sums, fields).groupBy("point_id").agg(F.sum("n").alias("n"), *(F.sum(f"sum_{c}").alias(f"sum_{c}") for c in "rgb"), *(F.max(f"own_{c}").alias(f"own_{c}") for c in "rgb"))
    return rows.select("point_id", *(F.coalesce(F.when(F.col("n") > 0, colour.rounded(F.col(f"sum_{c}") / F.nullif("n", F.lit(0)))), F.col(f"own_{c}")).alias(f"c{c}") for c in "rgb"))


#: Luminance in single precision is a whole number of these below 256, so sums are exact.
UNIT = 2.0**-27
_HALF = 18


def light(planes: np.ndarray) -> np.ndarray:
    """Luminance in single precision, as doubles."""
    r, g, b = (planes[k].astype(float) for k in range(3))
    return (0.299 * r + 0.587 * g + 0.114 * b).astype(np.float32).astype(float)


class Moments:
    """Summed-area tables of gray values: of the values and, in three parts that fit 64 bits, of their squares."""

    def __init__(self, gray: np.ndarray):
        whole = np.round(gray / UNIT).astype(np.int64)
        high, low = whole >> _HALF, whole & ((1 << _HALF) - 1)
        self.tables = [summed(x) for x in (whole, high * high, high * low, low * low)]

    def of(self, y0: np.ndarray, x0: np.ndarray, y1: np.ndarray, x1: np.ndarray) -> list[np.ndarray]:
        return [boxed(t, y0, x0, y1, x1) for t in self.tables]


_MOMENTS = [f"{who}{k}" for who in ("cand", "temp") for k in range(4)]


def _spread(n: Column, who: str) -> Column:
    """n times the sum of squares less the squared sum of exact sums, in units squared: n^2 times the variance."""
    big = lambda c: c.cast("decimal(38,0)")
    value, high, middle, low = (big(F.col(f"{who}{k}")) for k in range(4))
    squares = high * F.lit(1 << 2 * _HALF).cast("decimal(11,0)") + middle * F.lit(2 << _HALF).cast("decimal(6,0)") + low
    return (big(big(squares) * n.cast("decimal(10,0)")) - big(value * value)).cast("double")


def captured(tiles: DataFrame, boxes: DataFrame, key: str, side: int = SIDE) -> DataFrame:
    """(key, width, height, gray) of boxes (key, image_id, x0, y0, x1, y1; ends exclusive): row-major luminance, from the tiles that they touch."""
    kind = boxes.schema[key].dataType.simpleString()
    rows = boxes.select(F.col(key).alias("key_"), "image_id", *(F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")))

    def parts(planes: np.ndarray, rows: pa.Table, y0: np.ndarray, x0: np.ndarray, y1: np.ndarray, x1: np.ndarray, top: int, left: int) -> Arrays:
        gray = light(planes)
        values = [gray[a:c, b:d] for a, b, c, d in zip(y0.tolist(), x0.tolist(), y1.tolist(), x1.tolist(), strict=True)]
        return {"key_": rows["key_"].combine_chunks(), "y": pa.array(y0 + top), "x": pa.array(x0 + left), "part_h": pa.array(y1 - y0), "part_w": pa.array(x1 - x0), "gray": pa.array([v.ravel() for v in values], pa.list_(pa.float64()))}

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pieces, starts = batch.column("pieces").values, batch.column("pieces").offsets.to_numpy()
            y, x, h, w = (pieces.field(c).to_numpy() for c in ("y", "x", "part_h", "part_w"))
            values, ends = pieces.field("gray").values.to_numpy(), pieces.field("gray").offsets.to_numpy()
            top, left = np.minimum.reduceat(y, starts[:-1]), np.minimum.reduceat(x, starts[:-1])
            height, width = np.maximum.reduceat(y + h, starts[:-1]) - top, np.maximum.reduceat(x + w, starts[:-1]) - left
            out = []
            for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                if b - a == 1:
                    out.append(values[ends[a] : ends[b]])
                    continue
                gray = np.zeros((height[i], width[i]))
                for j in range(a, b):
                    gray[y[j] - top[i] : y[j] - top[i] + h[j], x[j] - left[i] : x[j] - left[i] + w[j]] = values[ends[j] : ends[j + 1]].reshape(h[j], w[j])
                out.append(gray.ravel())
            sizes = np.cumsum([0, *map(len, out)])
            yield pa.RecordBatch.from_arrays([batch.column("key_"), pa.array(width), pa.array(height), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(out)))], [key, "width", "height", "gray"])

    found = _in_tiles(tiles, _parts(rows, side), parts, f"key_ {kind}, y long, x long, part_h long, part_w long, gray array<double>")
    pieces = found.repartition(tasks(tiles.sparkSession), "key_").groupBy("key_").agg(F.collect_list(F.struct("y", "x", "part_h", "part_w", "gray")).alias("pieces"))
    return pieces.select("key_", "pieces").mapInArrow(whole, f"{key} {kind}, width long, height long, gray array<double>")


def scored(blobs: DataFrame, tiles: DataFrame, templates: DataFrame, threshold: float = patterns.THRESHOLD, side: int = SIDE) -> DataFrame:
    """Blobs whose window is like their colour's template, with pattern_score, as `templates.scored` gives them of pixels.

    Means and variances of a window and of the template below it come from summed-area tables; only the products of the two are added up value by value."""
    rows = templates.select("color_id", "width", "height", "gray").collect() if (templates.agg(F.sum(F.size("gray"))).first()[0] or 0) <= patterns.MOST_VALUES else None
    if rows is None:
        raise ValueError(f"templates have at most {patterns.MOST_VALUES} values together")
    sent = {str(r.color_id): np.array(r.gray).reshape(r.height, r.width) for r in rows}
    half_up = lambda c: F.floor(F.col(c) + 0.5)
    t = F.broadcast(templates.select("color_id", F.col("width").alias("tw"), F.col("height").alias("th")))
    placed = blobs.join(image_sizes(tiles), "image_id").join(t, "color_id", "left").withColumn("id_", F.concat_ws(",", F.col("color_id").cast("string"), F.col("blob_id").cast("string")))
    placed = patterns.window(placed, half_up("x"), half_up("y"), F.col("tw"), F.col("th")).drop("width", "height")
    placed = placed.withColumns({"cw": F.col("x1") - F.col("x0"), "ch": F.col("y1") - F.col("y0")})
    near = (F.col("cw") >= 0.7 * F.col("tw")) & (F.col("ch") >= 0.7 * F.col("th"))
    # The template's middle part lies on the window; (ox, oy) is the template's corner in the image.
    middle = lambda a, b, c: (F.col(a) - F.floor((F.col(b) - F.col(c)) / 2)).cast("long")
    boxes = placed.where(near).select("image_id", "id_", F.col("color_id").cast("string").alias("color_id"), *(F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")), middle("x0", "tw", "cw").alias("ox"), middle("y0", "th", "ch").alias("oy"))
    held: dict[str, Moments] = {}

    def sums(planes: np.ndarray, rows: pa.Table, y0: np.ndarray, x0: np.ndarray, y1: np.ndarray, x1: np.ndarray, top: int, left: int) -> Arrays:
        gray = light(planes)
        out = {"image_id": rows["image_id"].combine_chunks(), "id_": rows["id_"].combine_chunks(), "n": (y1 - y0) * (x1 - x0)}
        cand, temp, cross = Moments(gray).of(y0, x0, y1, x1), np.zeros((4, len(y0)), np.int64), np.zeros(len(y0))
        shift_y, shift_x = top - rows["oy"].to_numpy(), left - rows["ox"].to_numpy()
        for i, name in enumerate(rows["color_id"].to_pylist()):
            if name not in held:
                held[name] = Moments(sent[name])
            a, b, c, d = int(y0[i] + shift_y[i]), int(x0[i] + shift_x[i]), int(y1[i] + shift_y[i]), int(x1[i] + shift_x[i])
            temp[:, i] = held[name].of(a, b, c, d)
            cross[i] = np.vdot(sent[name][a:c, b:d], gray[y0[i] : y1[i], x0[i] : x1[i]])
        return out | dict(zip(_MOMENTS, [*cand, *temp], strict=True)) | {"cross": cross}

    kind = tiles.schema["image_id"].dataType.simpleString()
    parts = _in_tiles(tiles, _parts(boxes, side), sums, ", ".join([f"image_id {kind}", "id_ string", "n long", *(f"{m} long" for m in _MOMENTS), "cross double"]))
    whole = parts.groupBy("image_id", "id_").agg(*(F.sum(c).alias(c) for c in ("n", *_MOMENTS, "cross")))
    n = F.col("n").cast("double")
    under = F.sqrt((_spread(F.col("n"), "cand") / n) * (_spread(F.col("n"), "temp") / n)) * UNIT * UNIT
    over = F.col("cross") - F.col("cand0").cast("double") * F.col("temp0").cast("double") / n * UNIT * UNIT
    whole = whole.select("image_id", "id_", "n", F.when(under >= patterns.FLAT, over / under).alias("ncc"))
    both = placed.join(dealt(whole), ["image_id", "id_"], "left")
    same = (F.col("cw") == F.col("tw")) & (F.col("ch") == F.col("th"))
    score = F.when(same, F.coalesce("ncc", F.lit(0.0))).otherwise(F.when(F.col("n") >= patterns.LEAST_PIXELS, F.coalesce("ncc", F.lit(patterns.UNDECIDED))).otherwise(patterns.UNDECIDED))
    final = patterns.window_score(score, F.col("tw").isNotNull(), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("tw"), F.col("th"))
    return both.withColumn("pattern_score", final).where(F.col("tw").isNull() | (F.col("pattern_score") >= threshold)).select(*[c for c in blobs.columns if c != "pattern_score"], "pattern_score")
