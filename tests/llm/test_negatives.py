"""The join of hard negatives against all pairs, over shapes that its bounds, groups and slices treat differently, and odd rows."""

import math

import numpy as np
import pytest

from fernglass.llm import negatives

SCHEMA = "vec_id long, label string, embedding array<float>, score double, v binary, cell int, cls long, unit int"


def frame(spark, rows):
    return spark.createDataFrame([(i, k, x, 1.0, b"x", 1, 1, 1) for i, k, x in rows], SCHEMA)


def brute(rows, every=50, positives=5, k=3):
    """All pairs of rows that take part, exact repeats once."""
    whole = {}
    for i, label, x in rows:
        if i is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            v = [math.floor(256 * float(np.float32(c))) for c in x]
            if sum(c * c for c in v) <= 2**52:
                whole[(i, label, tuple(v))] = None
    out = []
    for a in whole:
        if a[0] % every == 0:
            scored = sorted((-sum(p * q for p, q in zip(a[2], b[2], strict=False)), b[0], b[1]) for b in whole if b != a)
            for s, i, _ in [x for x in scored if x[2] == a[1]][:positives]:
                fits = [(t, j) for t, j, label in scored if label != a[1] and 50 * -s <= 100 * -t <= 95 * -s][:k]
                out += [(a[0], i, r + 1, j, -s, -t) for r, (t, j) in enumerate(fits)]
    return sorted(out)


def made(rows, dim, families, seed, spread=0.15, lengths=(1.0, 1.0)):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(families, dim))
    out = []
    for i in range(rows):
        x = centres[rng.integers(families)] + spread * rng.normal(size=dim)
        x *= rng.uniform(*lengths) / np.linalg.norm(x)
        out.append((i, f"l{rng.integers(4)}", [float(c) for c in x.astype(np.float32)]))
    return out


@pytest.mark.parametrize(
    ("rows", "options"),
    [
        (made(700, 16, 6, 1), {}),
        (made(700, 16, 6, 2), {"group": 3, "rows": 40, "pivots": 20}),  # several groups and slices: bounds decide
        (made(600, 8, 5, 3, 0.05, (0.2, 3.0)), {"group": 2, "rows": 64}),  # lengths differ: the added component counts
        (made(500, 24, 400, 4), {"group": 1, "rows": 50, "pivots": 5}),  # no families: bounds prune little; crowded cells are dealt out
    ],
)
def test_equal_to_all_pairs(spark, rows, options):
    got = sorted(map(tuple, negatives.hard_negatives(frame(spark, rows), every=10, **options).collect()))
    assert got == brute(rows, 10) and got


def test_hot_vectors_and_ties(spark):
    """A third of all rows share one vector, another third is nearly equal; ids decide."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=12)
    rows = [(i, "ab"[i % 7 == 0], [float(c) for c in np.float32(base if i % 3 == 0 else base + 0.01 * rng.normal(size=12) if i % 3 == 1 else rng.normal(size=12))]) for i in range(900)]
    for options in ({}, {"group": 4, "rows": 30}):
        assert sorted(map(tuple, negatives.hard_negatives(frame(spark, rows), every=15, **options).collect())) == brute(rows, 15)


def test_odd_rows(spark):
    rows = made(200, 6, 3, 6)
    rows += [(None, "l1", [0.5] * 6), (1000, None, [0.5] * 6), (1050, "l1", None), (1100, "l1", [0.5, None, 0.5, 0.5, 0.5, 0.5]), (1150, "l1", [math.nan] * 6), (1200, "l2", [math.inf] * 6)]
    rows += [(1250, "l1", [3e38] * 6), (1300, "l1", []), (1350, "l2", [0.5, 0.25]), (1400, "l2", [0.0] * 6), (1450, "l3", [1.0] * 9), (1500, "alone", [0.3] * 6)]
    rows += [rows[0], rows[0], (0, "l1", [0.1] * 6), (0, rows[0][1], [0.2] * 6)]
    got = sorted(map(tuple, negatives.hard_negatives(frame(spark, rows), group=2, rows=40).collect()))
    assert got == brute(rows) and not {1000, 1050, 1100, 1150, 1200, 1250} & {x for r in got for x in (r[0], r[1], r[3])}


def test_empty_and_without_anchors(spark):
    assert negatives.hard_negatives(frame(spark, [])).count() == 0
    assert negatives.hard_negatives(frame(spark, [(7, "a", [1.0]), (9, "b", [1.0])])).count() == 0
    assert negatives.hard_negatives(frame(spark, [(50, "a", [1.0]), (9, "b", [1.0])])).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_bounds_keep_rows_from_groups(spark, monkeypatch):
    """Far families are not sent to each other's groups."""
    rows = made(2000, 24, 8, 7, 0.02)
    sent = []
    whole = negatives.routed

    def watched(*args):
        out = whole(*args)
        sent.append(out[0].count())
        return out

    monkeypatch.setattr(negatives, "routed", watched)
    got = sorted(map(tuple, negatives.hard_negatives(frame(spark, rows), every=10, group=25).collect()))
    assert got == brute(rows, 10)
    # Crowded cells are dealt to two groups; all to all would be 20 groups and more.
    assert 2000 <= sent[0] < 3000 and sent[1] < 1000 and sent[2] < 3000, sent
