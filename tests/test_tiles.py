"""Tiles against pixel rows: regions, counts, samples and windows over borders of tiles, many colours, and a large image."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fernglass.functions import colour
from fernglass.operators import raster, templates, tiles
from fernglass.sources import images

PALETTE = [(1, "a", 128, 128, 128), (2, "b", 160, 128, 96), (3, "c", 96, 128, 160)]


def palette(spark, rows=PALETTE):
    return spark.createDataFrame(rows, "id int, name string, r int, g int, b int")


def planes(h, w, seed, rough=3):
    """Patches of colours near the palette's, some clear."""
    rng = np.random.default_rng(seed)
    small = np.array([p[2:] for p in PALETTE] + [(250, 250, 250), (5, 5, 5)])[rng.integers(0, 5, (-(-h // rough), -(-w // rough)))]
    rgb = np.repeat(np.repeat(small, rough, 0), rough, 1)[:h, :w].transpose(2, 0, 1) + rng.integers(-9, 10, (3, h, w))
    return np.concatenate([rgb.clip(0, 255), np.where(rng.random((1, h, w)) < 0.05, 10, 255)]).astype(np.uint8)


def table(spark, found, side):
    rows = [(image, *t) for image, p in found.items() for t in tiles.cut(p, side)]
    return spark.createDataFrame(rows, f"image_id string, {tiles.FIELDS}")


def rows(df, *columns):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in (df.select(*columns) if columns else df).collect())


@pytest.fixture(scope="module")
def found():
    return {"one": planes(50, 37, 1), "two": planes(33, 70, 2, 5), "thin": planes(1, 90, 3), "dot": planes(1, 1, 4)}


@pytest.mark.parametrize("side", [13, 64])
def test_equal_to_pixel_rows(spark, found, side):
    t = table(spark, found, side)
    px = tiles.pixels(t).cache()
    assert px.count() == sum(p[0].size for p in found.values())
    blobs = raster.regions(raster.colour_mask(px, palette(spark)), 2)
    assert rows(tiles.regions(t, palette(spark), least=2), *blobs.columns) == rows(blobs)
    assert rows(tiles.match_counts(t, palette(spark))) == rows(raster.match_counts(px, palette(spark)))
    assert rows(tiles.mean_colours(t)) == rows(raster.mean_colours(px))
    assert rows(tiles.row_shares(t)) == rows(raster.row_density(px))
    assert rows(tiles.image_sizes(t)) == rows(raster.image_sizes(px))
    assert rows(tiles.pixels(tiles.highlighted(t, (128, 128, 128)))) == rows(raster.highlighted(px, (128, 128, 128)))
    bands = raster.row_bands(raster.row_density(px), 0.2, 2)
    assert rows(raster.colours_of_bands(bands, tiles.swatch_sums(t))) == rows(raster.band_colours(px, bands))
    points = spark.createDataFrame([(i, n, (i * 7) % p.shape[2], (i * 11) % p.shape[1]) for n, p in found.items() for i in range(hash(n) % 3, 120, 3)], "point_id long, image_id string, px int, py int")
    points = points.withColumn("point_id", F.monotonically_increasing_id()).cache()
    assert rows(tiles.sampled_colour(t, points, side=side)) == rows(raster.sampled_colour(px, points))


def test_regions_of_a_mask_in_tiles_of_many_sizes(spark, found):
    t = table(spark, found | {"gray": np.full((4, 20, 20), 128, np.uint8)}, 13)
    assert len({(r.h, r.w) for r in t.select("h", "w").collect()}) > 5
    mask = tiles.pixels(t).where(colour.coloured(F.col("r"), F.col("g"), F.col("b"))).withColumn("color_id", F.lit(0).cast("long"))
    want, got = raster.regions(mask, 1), tiles.mask_regions(t, tiles.coloured, sized=True).cache()
    assert rows(got, *want.columns) == rows(want) and got.count() > 10
    assert {(r.image_id, r.width, r.height) for r in got.collect()} <= {(n, p.shape[2], p.shape[1]) for n, p in found.items()}


@pytest.mark.parametrize("side", [7])
def test_windows_equal_to_pixel_rows(spark, found, side):
    flat = dict(found, flat=np.full((4, 40, 40), 128, np.uint8) | np.array([0, 0, 0, 255], np.uint8)[:, None, None])
    t = table(spark, flat, side)
    px = tiles.pixels(t).cache()
    blobs = raster.regions(raster.colour_mask(px, palette(spark)), 2).cache()
    points = spark.createDataFrame([(1, "one", 20.0, 30.0), (2, "two", 3.0, 2.0)], "color_id int, image_id string, px double, py double")
    boxes = templates.capture_boxes(points, raster.image_sizes(px), 11)
    old, new = templates.tiles(px, boxes, "color_id").cache(), tiles.captured(t, boxes, "color_id", side)
    assert [(r.color_id, r.width, r.height, r.gray) for r in new.orderBy("color_id").collect()] == [(r.color_id, r.width, r.height, r.gray) for r in old.orderBy("color_id").collect()]
    want = templates.scored(blobs, px, old, raster.image_sizes(px), -2.0)
    got = tiles.scored(blobs, t, old, -2.0, side)
    assert rows(got, *want.columns) == rows(want)
    scores = {r.pattern_score for r in got.where("image_id = 'flat'").collect()}
    assert scores and scores <= {0.0, 0.5, 1.0}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 120), st.lists(st.integers(0, (1 << 24) - 1), min_size=1, max_size=40), st.integers(0, 10**6))
def test_grid_finds_what_comparing_all_finds(tolerance, seen, seed):
    rng = np.random.default_rng(seed)
    ids, rgb, seen = np.arange(60), rng.integers(0, 256, (60, 3)), np.unique(seen)
    colours, places = tiles.Grid(ids, rgb, tolerance).pairs(seen)
    there = np.stack([seen >> 16, seen >> 8 & 255, seen & 255], 1)
    want = ((there[:, None] - rgb[None]) ** 2).sum(2) < tolerance**2
    assert sorted(zip(places.tolist(), colours.tolist(), strict=True)) == [tuple(x) for x in np.argwhere(want).tolist()]


def test_ten_thousand_colours(spark):
    rng = np.random.default_rng(8)
    rgb = rng.integers(0, 256, (10_000, 3))
    many = palette(spark, [(i, f"c{i}", *map(int, c)) for i, c in enumerate(rgb)])
    p = planes(40, 40, 9)
    got = {r.color_id: r.matches for r in tiles.match_counts(table(spark, {"x": p}, 32), many, 25).collect()}
    solid = p[:3, p[3] >= 128].T.astype(int)
    n = np.zeros(10_000, int)
    for px in solid:
        n += ((px - rgb) ** 2).sum(1) < 625
    assert got == {i: int(k) for i, k in enumerate(n) if k}
    with pytest.raises(ValueError, match="10000"):
        tiles.match_counts(table(spark, {"x": p}, 32), many.unionByName(many.limit(1)))


def test_only_near_colours_are_compared():
    """What a pixel costs depends on the colours near it, not on the palette's size."""
    rng = np.random.default_rng(1)
    grid = tiles.Grid(np.arange(10_000), rng.integers(0, 256, (10_000, 3)), 40)
    sizes = [len(grid.cell(int(a) << 16 | int(b) << 8 | int(c))) for a, b, c in rng.integers(0, 12, (50, 3))]
    assert max(sizes) < 900


def test_null_planes_and_empty_tables(spark, found):
    t = table(spark, found, 16)
    gone = t.withColumn("planes", F.when(F.col("tx") > 0, F.col("planes")))
    assert tiles.pixels(gone).count() < tiles.pixels(t).count()
    assert rows(tiles.regions(gone, palette(spark), least=1))
    none = t.limit(0)
    assert tiles.regions(none, palette(spark)).count() == 0 and tiles.match_counts(none, palette(spark)).count() == 0
    assert tiles.regions(t, palette(spark).limit(0)).count() == 0
    assert tiles.sampled_colour(none, spark.createDataFrame([(1, "one", 1, 1)], "point_id long, image_id string, px int, py int")).count() == 0


def png(path, rgb):
    h, w = rgb.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in rgb)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_files_become_tiles_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    png(tmp_path / "in" / "a.png", np.random.default_rng(3).integers(0, 256, (30, 41, 3)).astype(np.uint8))
    decoded = images.images(spark, f"file://{tmp_path}/in")
    made = []

    def make():
        made.append(1)
        return images.tiles(decoded, 16)

    for _ in range(2):
        t = images.kept(spark, f"file://{tmp_path}/tiles", make)
        assert rows(tiles.pixels(t), "y", "x", "r", "g", "b", "a") == rows(images.pixels(decoded), "y", "x", "r", "g", "b", "a")
    assert made == [1] and t.count() == 6


def test_hundred_megapixels(spark):
    """10,000 x 10,000 pixels, a tile at a time: a comb that joins all tiles, and dots apart. No row for each pixel is made."""
    import pyarrow as pa

    side, n = 500, 10_000

    def make(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                y, x = np.mgrid[k // 20 * side : (k // 20 + 1) * side, k % 20 * side : (k % 20 + 1) * side]
                hit = (x % 40 < 4) | (y < 4)
                dot = (x % 40 == 20) & (y % 40 == 20)
                p = np.full((4, side, side), 255, np.uint8)
                p[0][hit], p[1][hit], p[2][hit] = 200, 10, 10
                p[0][dot], p[1][dot], p[2][dot] = 10, 200, 10
                t = next(tiles.cut(p, side))
                yield tiles.batch_of(pa.scalar("big"), [(k // 20, k % 20, k // 20 * side, k % 20 * side, side, side, n, n, t[-1])])

    big = spark.range(0, 400, 1, 16).mapInArrow(make, f"image_id string, {tiles.FIELDS}")
    got = tiles.regions(big, palette(spark, [(1, "red", 200, 10, 10), (2, "green", 10, 200, 10)]), least=1)
    counts = {r.color_id: (r.n, r.size) for r in got.groupBy("color_id").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
    red = got.where("color_id = 1").first()
    assert counts == {1: (1, n * n // 10 + 4 * n - 4 * n // 10), 2: (62_500, 62_500)}
    assert (red.min_x, red.max_x, red.min_y, red.max_y, red.blob_id) == (0, 9999, 0, 9999, 0)
