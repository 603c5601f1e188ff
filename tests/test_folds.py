"""Folds in order, joins by buckets, statistics by digits and the index of swatches: against plain versions, and large."""

import random
import time

import pytest
from pyspark.sql import functions as F

from fernglass.operators import layout, selection, swatches


def plain_names(names):
    kept = []
    for t in names:
        p = None if t is None else "".join(c for c in t.lower() if "a" <= c <= "z")
        if p is None or not any(q is not None and (p == q or (p.startswith(q) or q.startswith(p)) and abs(len(p) - len(q)) < 5) for _, q in kept):
            kept.append((t, p))
    return [t for t, _ in kept]


def test_near_names_equal_to_the_plain_fold(spark):
    r = random.Random(1)
    keys = {k: [r.choice([None, "", "12"]) if r.random() < 0.05 else "".join(r.choices("aAb -", k=r.randint(0, 9))) for _ in range(120)] for k in ("x", "y", None)}
    df = spark.createDataFrame([(k, i, t) for k, names in keys.items() for i, t in enumerate(names)], "key string, o int, t string").repartition(5)
    got = layout.without_near_names(df, "key", "o", "t")
    assert got.columns == ["key", "o", "t"]
    rows = sorted(got.collect(), key=lambda x: x.o)
    for k, names in keys.items():
        assert [x.t for x in rows if x.key == k] == plain_names(names)


def test_hundred_thousand_names_of_one_key(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    df = spark.range(100_000).select(F.lit("one").alias("key"), F.col("id").alias("o"), F.concat(*(F.substring(F.lit(letters), (F.shiftright("id", 3 * k) % 8 + 1).cast("int"), F.lit(1)) for k in range(6)), F.lit("-tail-of-it")).alias("t"))
    began = time.perf_counter()
    assert layout.without_near_names(df, "key", "o", "t").count() == 100_000
    assert time.perf_counter() - began < 30


def plain_merge(items):
    used, out = set(), []
    for i, a in enumerate(items):
        if i in used:
            continue
        a = list(a)
        for j in range(i + 1, len(items)):
            b = items[j]
            if j not in used and sum((a[k] - b[k]) ** 2 for k in (2, 3, 4)) <= 2500 and a[5] - 10 <= b[6] and a[6] + 10 >= b[5] and a[7] - 10 <= b[8] and a[8] + 10 >= b[7]:
                used.add(j)
                a[1] += b[1]
                a[5:] = min(a[5], b[5]), max(a[6], b[6]), min(a[7], b[7]), max(a[8], b[8])
        out.append(tuple(a))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_indexed_merge_equal_to_the_plain_fold(seed):
    r = random.Random(seed)
    items = []
    for i in range(160):
        x, y, w, h = r.randint(-50, 700), r.randint(0, 500), int(r.expovariate(0.05)), int(r.expovariate(0.05))
        items.append((i, r.randint(1, 90), *(r.choice([0, 30, 60, 110, 255]) for _ in range(3)), x, x + w, y, y + h))
    assert swatches.merged_in_order(items) == plain_merge(items)


def test_parts_of_an_image_are_folded_in_many_tasks(spark):
    r, items = random.Random(3), {}
    for image in ("i", "j"):
        boxes = [(r.randint(0, 90), r.randint(0, 3000), int(r.expovariate(0.1)), int(r.expovariate(0.1))) for _ in range(300)]
        items[image] = [(i, r.randint(1, 90), *(r.choice([0, 30, 60, 255]) for _ in range(3)), x, x + w, y, y + h) for i, (x, y, w, h) in enumerate(boxes)]
    df = spark.createDataFrame([(k, 248, *v) for k, rows in items.items() for v in rows], f"image_id string, width long, {swatches.MERGED}")
    got = swatches.merge_near(df, ("width",), 16).select("image_id", "width", *(f.split()[0] for f in swatches.MERGED.split(", ")), F.spark_partition_id().alias("task")).collect()
    for image, rows in items.items():
        assert sorted(tuple(x)[2:-1] for x in got if x.image_id == image) == plain_merge(rows)
        assert len({x.task for x in got if x.image_id == image}) > 1
    assert {x.width for x in got} == {248}


def test_hundred_thousand_swatches_of_one_image(spark):
    col = lambda e: F.expr(e).cast("long")
    df = spark.range(100_000).select(F.lit("i").alias("image_id"), F.col("id").alias("idx"), F.lit(5).alias("size"), *(col(e).alias(c) for e, c in (("id % 7 * 36", "cr"), ("id % 3 * 100", "cg"), ("0", "cb"), ("id % 400 * 20", "min_x"), ("id % 400 * 20 + 12", "max_x"), ("id div 400 * 20", "min_y"), ("id div 400 * 20 + 12", "max_y"))))
    began = time.perf_counter()
    got = swatches.merge_near(df).agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    assert got["size"] == 500_000 and 1 < got.n < 100_000
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("scale", [1, 3_000_000, -(10**14)])
def test_order_statistics_equal_to_sorting(spark, scale):
    r = random.Random(scale)
    rows = [(k, r.randint(-40, 40) * scale + r.randint(0, 70_000)) for k in ("a", "b", None) for _ in range(r.randint(1, 400))] + [("a", None), ("only", 5)]
    got = {x.k: (x.n_, x.low, x.high) for x in selection.order_statistics(spark.createDataFrame(rows, "k string, v long"), "k", "v", {"low": 0.25, "high": 0.75}).collect()}
    for k in ("a", "b", None, "only"):
        s = sorted(v for j, v in rows if j == k and v is not None)
        assert got[k] == (len(s), s[int(len(s) * 0.25)], s[int(len(s) * 0.75)])
    with pytest.raises(ValueError, match="whole"):
        selection.order_statistics(spark.createDataFrame([("a", 1.5)], "k string, v double"), "k", "v", {"low": 0.5})


def test_size_fence_of_a_large_key(spark):
    """A million areas of one key: no window stands over its rows, only over digits."""
    df = spark.range(1_000_000).select(F.lit("one").alias("image_id"), (F.col("id") * 7919 % 1_000_003).alias("area"))
    fenced = swatches.size_fence(df)
    assert "Window" not in fenced._jdf.queryExecution().optimizedPlan().toString()
    low = sorted(i * 7919 % 1_000_003 for i in range(1_000_000))[250_000]
    assert fenced.count() == sum(v >= 0.05 * low for v in range(1_000_003)) - sum(v >= 0.05 * low for v in set(range(1_000_003)) - {i * 7919 % 1_000_003 for i in range(1_000_000)})


def test_banded_join_equal_to_all_pairs(spark):
    r = random.Random(4)
    spans = [("i" if k % 3 else "j", k, low := r.uniform(-300, 900), low + r.choice([-1, 0, 0.3, 5, 40, 700])) for k in range(200)]
    points = [(r.choice("ij"), k, r.uniform(-300, 1500)) for k in range(300)]
    a, b = spark.createDataFrame(spans, "image_id string, s int, low double, high double"), spark.createDataFrame(points, "image_id string, p int, at double")
    joined = layout.banded(a, b)
    assert sorted((x.s, x.p) for x in joined.collect()) == sorted((s[1], p[1]) for s in spans for p in points if s[0] == p[0] and s[2] <= p[2] <= s[3])
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "cell_" in plan and "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()


def test_boundaries_and_words_equal_to_plain_versions(spark):
    r = random.Random(6)
    sw = []
    for image in "ab":
        for i in range(60):
            x, y = r.randint(0, 900), r.randint(0, 500)
            sw.append((image, i, i, 1, 1, 1, x, x + r.randint(5, 40), y, y + r.randint(2, 60)))
    words = []
    for image in "ab":
        for i in range(400):
            x, y = r.randint(0, 1000), r.randint(0, 560)
            words.append((image, i, "w", 50.0, x, y, x + r.randint(5, 60), y + r.randint(4, 20)))
    swd = spark.createDataFrame(sw, "image_id string, idx int, blob_id long, cr long, cg long, cb long, min_x long, max_x long, min_y long, max_y long")
    wd = spark.createDataFrame(words, "image_id string, word_idx int, text string, confidence double, x0 int, y0 int, x1 int, y1 int")
    sizes = spark.createDataFrame([("a", 1000, 600), ("b", 700, 600)], "image_id string, width int, height int")
    bounded = layout.right_boundaries(swd, sizes)
    got = {(x.image_id, x.ord): x.right_boundary for x in bounded.collect()}
    assigned = sorted((x.image_id, x.ord, x.word_idx, x.place) for x in layout.assign_words(bounded, wd).collect())
    want, wanted = {}, []
    for image, width in (("a", 1000), ("b", 700)):
        s = sorted((x for x in sw if x[0] == image), key=lambda x: (x[8] // 25, x[6], x[1]))
        for o, a in enumerate(s):
            far, mid = a[7] + width * 0.15, (a[8] + a[9]) / 2
            beside = next((b[6] for b in s[o + 1 :] if abs((b[8] + b[9]) / 2 - mid) < (a[9] - a[8]) * 1.2 and b[6] > a[7]), None)
            want[image, o] = min(far, beside - 5) if beside is not None else far
        free = {x[1]: x for x in words if x[0] == image}
        for o, a in enumerate(s):
            pad = min(10, 0.3 * (a[9] - a[8]))
            mine = sorted((v for v in free.values() if a[7] - 5 <= v[4] <= want[image, o] and a[8] - pad <= (v[5] + v[7]) / 2 <= a[9] + pad), key=lambda v: (v[4], v[1]))
            for place, v in enumerate(mine):
                if place and v[4] - mine[place - 1][6] > 50:
                    break
                del free[v[1]]
                wanted.append((image, o, v[1], place))
    assert got == want and assigned == sorted(wanted) and len(assigned) > 50
