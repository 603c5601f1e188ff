import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernglass.functions import colour
from fernglass.operators import raster, swatches, templates, tiles
from fernglass.operators.components import numbered, pixel_components

PIXEL = "image_id string, y long, x long, r int, g int, b int, a int"


def image(spark, name, grid, colours, alpha=255):
    """Rows of characters as pixels."""
    return spark.createDataFrame([(name, y, x, *colours[c], alpha) for y, row in enumerate(grid) for x, c in enumerate(row)], PIXEL)


def flood(mask):
    """8-connected components by breadth-first search: sorted lists of cells."""
    left, out = set(mask), []
    while left:
        queue = [left.pop()]
        part = list(queue)
        while queue:
            y, x = queue.pop()
            for cell in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if cell in left:
                    left.remove(cell)
                    queue.append(cell)
                    part.append(cell)
        out.append(sorted(part))
    return sorted(out)


@pytest.mark.parametrize("seed,share", [(1, 0.3), (2, 0.5)])
def test_regions_equal_a_flood_fill(spark, seed, share):
    rng = random.Random(seed)
    cells = {(y, x): (rng.randrange(256), 5, 9) for y in range(25) for x in range(30) if rng.random() < share}
    mask = spark.createDataFrame([("i", 1, y, x, *c) for (y, x), c in cells.items()], "image_id string, color_id int, y long, x long, r int, g int, b int")
    got = sorted((r.min_y, r.max_y, r.min_x, r.max_x, r["size"], round(r.x, 9), round(r.y, 9), r.cr) for r in raster.regions(mask, 2).collect())
    want = []
    for part in flood(cells):
        if len(part) >= 2:
            ys, xs = [p[0] for p in part], [p[1] for p in part]
            want.append((min(ys), max(ys), min(xs), max(xs), len(part), round(sum(xs) / len(xs), 9), round(sum(ys) / len(ys), 9), int(sum(cells[p][0] for p in part) / len(part) + 0.5)))
    assert got == sorted(want)
    assert raster.regions(mask.limit(0), 1).count() == 0


def test_tolerance_and_alpha_are_strict(spark):
    px = spark.createDataFrame([("i", 0, 0, 40, 0, 0, 255), ("i", 0, 1, 39, 0, 0, 255), ("i", 0, 2, 0, 0, 0, 127), ("i", 0, 3, 0, 0, 0, 128)], PIXEL)
    palette = spark.createDataFrame([(1, "x", 0, 0, 0)], "id int, name string, r int, g int, b int")
    assert sorted(r.x for r in raster.colour_mask(px, palette, 40).collect()) == [1, 3]


BLOB = "image_id string, color_id int, blob_id long, x double, y double, size long, cr long, cg long, cb long, min_x long, max_x long, min_y long, max_y long"


@pytest.mark.parametrize("seed", (1, 2))
def test_merging_equals_union_find(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        x, y, w, h = rng.randrange(400), rng.randrange(400), rng.randrange(1, 40), rng.randrange(1, 40)
        rows.append(("i", rng.randrange(2), i, x + w / 2, y + h / 2, rng.randrange(1, 99), rng.randrange(256), 0, 0, x, x + w, y, y + h))
    parent = list(range(60))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    reach = [max(15, 0.5 * max(r[10] - r[9], r[12] - r[11])) for r in rows]
    for i in range(60):
        for j in range(i):
            p, a, b = max(reach[i], reach[j]), rows[i], rows[j]
            if a[1] == b[1] and a[9] - p <= b[10] and a[10] + p >= b[9] and a[11] - p <= b[12] and a[12] + p >= b[11]:
                u, v = find(i), find(j)
                parent[max(u, v)] = min(u, v)
    want = []
    for root in {find(i) for i in range(60)}:
        part = [rows[i] for i in range(60) if find(i) == root]
        n = sum(r[5] for r in part)
        want.append((root, n, round(sum(r[3] * r[5] for r in part) / n, 9), int(sum(r[6] * r[5] for r in part) / n + 0.5), min(r[9] for r in part), len(part)))
    got = [(r.blob_id, r["size"], round(r.x, 9), r.cr, r.min_x, r.parts) for r in raster.merged(spark.createDataFrame(rows, BLOB), 15).collect()]
    assert sorted(got) == sorted(want)


def test_aspect_is_strict(spark):
    rows = [("i", 1, i, 0.0, 0.0, 1, 0, 0, 0, 0, w, 0, h) for i, (w, h) in enumerate([(7, 0), (8, 0), (8, 1), (15, 2), (16, 2)])]
    assert sorted(r.blob_id for r in raster.compact(spark.createDataFrame(rows, BLOB)).collect()) == [0, 3]


def test_bands(spark):
    density = spark.createDataFrame([("i", y, float(c == "#")) for y, c in enumerate("..####..####..###....####.....####")], "image_id string, y long, density double")
    got = sorted((r.y_start, r.y_end) for r in raster.row_bands(density).collect())
    assert got == [(2, 12), (21, 25)]  # gaps of 2 are closed; the last run ends at its own last row and so is 3 high
    longer = spark.createDataFrame([("i", y, 1.0) for y in range(5)], "image_id string, y long, density double")
    assert [(r.y_start, r.y_end) for r in raster.row_bands(longer).collect()] == [(0, 4)]


def test_swatches_end_to_end(spark):
    red, green, paper = (200, 30, 30), (30, 160, 40), (255, 255, 255)
    grid = [["."] * 200 for _ in range(160)]
    for top, c in ((10, "R"), (60, "G"), (110, "R")):
        for y in range(top, top + 20):
            for x in range(8, 26):
                grid[y][x] = c
    for x in range(60, 160):  # a line is no swatch
        grid[20][x] = "G"
    got = sorted((r.min_y, r.cr, r.cg, r["size"], r.idx) for r in swatches.detect(tiles.of_pixels(image(spark, "i", grid, {"R": red, "G": green, ".": paper}), 32)).collect())
    assert got == [(10, 200, 30, 360, 0), (60, 30, 160, 360, 1), (110, 200, 30, 360, 2)]


def test_near_swatches_are_folded_in_order(spark):
    rows = [(0, 10, 0, 20, 100), (1, 25, 0, 40, 130), (2, 48, 0, 60, 100), (3, 200, 0, 220, 100)]  # the second is near in place and colour; the third only once the box has grown
    df = spark.createDataFrame([("i", i, 50, c, 0, 0, a, b, 0, 10) for i, a, _, b, c in rows], "image_id string, idx int, size long, cr long, cg long, cb long, min_x long, max_x long, min_y long, max_y long")
    got = sorted((r.idx, r["size"], r.min_x, r.max_x, r.cr) for r in swatches.merge_near(df).collect())
    assert got == [(0, 150, 10, 60, 100), (3, 50, 200, 220, 100)]


def test_size_fence(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4, 100)] + [("b", v) for v in (1, 1, 1, 9999)], "image_id string, area long")
    got = sorted((r.image_id, r.area) for r in swatches.size_fence(df).collect())
    assert got == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 1), ("b", 1), ("b", 1), ("b", 9999)]


def test_ncc(spark):
    cases = [([1.0, 2, 3], [2.0, 4, 6], 1.0), ([1.0, 2, 3], [3.0, 2, 1], -1.0), ([1.0, 1], [1.0, 2], 0.0), ([1.0], [1.0, 2], 0.0), ([], [], 0.0)]
    df = spark.createDataFrame([(i, [float(v) for v in a], [float(v) for v in b]) for i, (a, b, _) in enumerate(cases)], "i int, a array<double>, b array<double>")
    got = [round(r.s, 9) for r in df.select("i", templates.ncc(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()]
    assert got == [c[2] for c in cases]


def test_overlap_is_centred(spark):
    a = [float((7 * i) % 11) for i in range(36)]
    inner = [a[(y + 1) * 6 + x + 1] for y in range(4) for x in range(4)]
    one, small = F.array(*map(F.lit, a)), F.array(*map(F.lit, inner))
    row = spark.range(1).select(templates.overlap_ncc(one, F.lit(6), F.lit(6), small, F.lit(4), F.lit(4)).alias("same"), templates.overlap_ncc(one, F.lit(6), F.lit(6), F.slice(small, 1, 9), F.lit(3), F.lit(3)).alias("few")).first()
    assert round(row.same, 9) == 1.0 and row.few == 0.5


def test_colour_measures(spark):
    df = spark.createDataFrame([(0, 0, 0), (110, 140, 175), (250, 250, 250), (60, 60, 70)], "r int, g int, b int")
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    got = df.select(colour.saturation(r, g, b).alias("s"), colour.blue_gray(r, g, b).alias("t"), colour.coloured(r, g, b).alias("c"), colour.grayish(r, g, b).alias("k"), colour.extreme(r, g, b).alias("e")).collect()
    assert [x.t for x in got] == [False, False, False, False] and got[0].s == 0.0 and [x.e for x in got] == [True, False, True, False] and [x.k for x in got] == [False, False, False, True]
    text = spark.createDataFrame([(120, 140, 170)], "r int, g int, b int").select(colour.blue_gray(r, g, b).alias("t"), colour.coloured(r, g, b).alias("c")).first()
    assert text.t and not text.c


def _raster(spark, gray):
    """One gray image (rows of levels) as pixels of image 0."""
    rows = [(0, y, x, v, v, v, 255) for y, line in enumerate(gray) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "image_id long, y long, x long, r int, g int, b int, a int")


def _gray(gray, x0, y0, x1, y1):
    return [[float(np.float32(v)) for v in line[x0:x1]] for line in gray[y0:y1]]


def test_windows_are_moved_into_the_image_and_scored(spark):
    rng = np.random.default_rng(4)
    gray = rng.integers(0, 256, (40, 40)).tolist()
    for y in range(24, 40):  # a flat corner
        gray[y][24:] = [90] * 16
    px = _raster(spark, gray)
    template = [v for line in _gray(gray, 0, 0, 8, 8) for v in line]
    tmpl = spark.createDataFrame([(1, 8, 8, template)], "color_id int, width int, height int, gray array<double>")
    points = [(1, 0, 2.0, 2.0), (1, 1, 32.0, 32.0), (1, 2, 39.0, 10.0), (1, 3, 36.6, 10.0), (1, 4, 4.0, 4.0), (2, 5, 1.0, 1.0)]
    blobs = spark.createDataFrame([(0, c, b, x, y) for c, b, x, y in points], "image_id long, color_id int, blob_id long, x double, y double")
    got = {r.blob_id: r.pattern_score for r in templates.scored(blobs, px, tmpl, raster.image_sizes(px), -1.0).collect()}
    t = np.array(template)

    def ncc(a, b):
        a, b = a - a.mean(), b - b.mean()
        return float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))

    cut = lambda x0, y0, x1, y1: np.array(_gray(gray, x0, y0, x1, y1))
    assert got[0] == pytest.approx(1.0) and got[4] == pytest.approx(1.0)  # the corner is moved, the window keeps its size
    assert got[1] == 0.0  # flat, of the template's size
    assert got[2] == 0.5  # 5 of 8 columns are too few
    # 7 of 8 columns: the middle 7 of the template against the window.
    assert got[3] == pytest.approx(ncc(t.reshape(8, 8)[:, 0:7].ravel(), cut(33, 6, 40, 14).ravel()), abs=1e-6)
    assert got[5] == 1.0  # a colour without a template
    assert {r.blob_id for r in templates.scored(blobs, px, tmpl, raster.image_sizes(px), 0.4).collect()} == {0, 2, 4, 5} | ({3} if got[3] >= 0.4 else set())


def test_template_boxes(spark):
    sizes = spark.createDataFrame([(0, 100, 60)], "image_id long, width long, height long")
    points = spark.createDataFrame([(0, 3.7, 50.2), (0, 99.0, 30.0)], "image_id long, px double, py double")
    box = lambda r: (r.x0, r.y0, r.x1, r.y1)
    assert sorted(map(box, templates.capture_boxes(points, sizes).collect())) == [(0, 34, 32, 60), (83, 14, 100, 46)]
    bands = spark.createDataFrame([(0, 10, 17), (0, 20, 31), (0, 20, 59)], "image_id long, y_start int, y_end int")
    assert sorted(map(box, templates.row_boxes(bands, sizes).collect())) == [(0, 27, 25, 52), (7, 20, 18, 31)]


def test_near_regions_of_unlike_sizes_are_paired_once(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        w, h = rng.choice(((3, 3), (30, 8), (200, 100), (1, 60))), rng.randrange(600)
        x, y = rng.randrange(600), h
        rows.append((0, 1, i, x, x + w[0], y, y + w[1]))
    df = spark.createDataFrame(rows, "image_id long, color_id int, blob_id long, min_x int, max_x int, min_y int, max_y int")
    want = set()
    for a in rows:
        for b in rows:
            if a[2] < b[2]:
                pad = max(5.0, *(0.5 * max(r[4] - r[3], r[6] - r[5]) for r in (a, b)))
                if a[3] - pad <= b[4] and a[4] + pad >= b[3] and a[5] - pad <= b[6] and a[6] + pad >= b[5]:
                    want.add((a[2], b[2]))
    got = [(r.a, r.b) for r in raster.near_edges(df, 5.0).collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("strip", (1, 2, 5, 512))
def test_strips_are_joined_at_their_borders(spark, strip):
    rng = random.Random(strip)
    cells = {(y, x) for y in range(24) for x in range(24) if rng.random() < 0.42} | {(y, 30) for y in range(24)}
    mask = spark.createDataFrame([("a", y, x) for y, x in cells] + [("b", 3, 3)], "image_id string, y long, x long")
    got = {}
    for r in pixel_components(mask, strip=strip).collect():
        for x in range(r.x0, r.x1 + 1):
            got.setdefault((r.image_id, r.root), []).append((r.y, x))
    want = {("a", min(y * 2**24 + x for y, x in part)): part for part in flood(cells)} | {("b", 3 * 2**24 + 3): [(3, 3)]}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_rows_are_numbered_in_order(spark):
    df = spark.createDataFrame([(i * 7919 % 500, "x") for i in range(500)], "k long, v string").repartition(6)
    assert [r.number for r in numbered(df, ("k",), "number", 3).orderBy("k").collect()] == list(range(3, 503))
    assert numbered(df.limit(0), ("k",), "number").count() == 0
