"""Importance resampling against a plain version, over odd rows; what the plan shuffles."""

import hashlib
import math
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from fernglass.llm import importance

SCHEMA = "doc_id long, text string, w array<string>, b int, n long, score double, weight int, rank int, range_ int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, ["x"], 1, 1, 1.0, 1, 1, 1) for i, t in rows], SCHEMA)


def features(text, order=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1)]


def plain(rows, target, least=20, share=25, n=10_000, order=2):
    raw, wanted = [0] * n, [0] * n
    for counts, texts in ((raw, [t for _, t in rows]), (wanted, target)):
        for t in texts:
            for f in features(t, order)[1]:
                counts[zlib.crc32(f.encode()) % n] += 1
    gain = [math.floor(1000 * math.log((t + 1) * (sum(raw) + n) / ((s + 1) * (sum(wanted) + n)))) for s, t in zip(raw, wanted, strict=True)]
    out = []
    for i, t in rows:
        words, found = features(t, order)
        weight = math.floor(sum(gain[zlib.crc32(f.encode()) % n] for f in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, words >= least])
    able = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0, -x[2], -x[1]))
    for r, x in enumerate(able[: share * len(able) // 100]):
        x[4] = r + 1
    return [tuple(x[:5]) for x in out]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x or 0) for x in r))


ROWS = [(i, " ".join(f"w{(i * k) % 37} Größe{k % 5}" for k in range(i % 50))) for i in range(200)]
ODD = [(900, None), (901, ""), (902, " .,;\x00\x7f "), (903, "one"), (904, "AbİC ÀB 日本語 𝒳y a-b_c"), (None, "nothing " * 30), (905, "long words " * 40_000), (906, "same text " * 20), (907, "same text " * 20), (906, "same text " * 20)]


def test_equal_to_the_plain_version(spark):
    target = ["w1 w2 w3 größe1", None, "", "the Größe2 is w5 and w7", "the Größe2 is w5 and w7"]
    got = importance.importance(documents(spark, ROWS + ODD).repartition(6), spark.createDataFrame([(t, 1) for t in target], "text string, b int"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert order(got.collect()) == order(plain(ROWS + ODD, target))


@pytest.mark.parametrize(("least", "share", "n", "k"), [(0, 100, 50, 1), (5, 33, 997, 3), (20, 0, 10_000, 2)])
def test_parameters(spark, least, share, n, k):
    got = importance.importance(documents(spark, ROWS), spark.createDataFrame([("w1 w2 w3",)], "text string"), order=k, n=n, least=least, share=share)
    assert order(got.collect()) == order(plain(ROWS, ["w1 w2 w3"], least, share, n, k))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.importance(documents(spark, []), none).count() == 0
    assert order(importance.importance(documents(spark, ROWS[:40]), none).collect()) == order(plain(ROWS[:40], []))


def test_texts_with_the_target_s_words_are_drawn_more_often(spark):
    """Half of the documents share the target's words: by far more of these are drawn."""
    rows = [(i, " ".join(f"{'common' if i % 2 else 'other'}{(i + k) % 40}" for k in range(30))) for i in range(1000)]
    got = importance.importance(documents(spark, rows), spark.createDataFrame([(" ".join(f"common{k}" for k in range(40)),)] * 100, "text string"))
    kept = [r.doc_id for r in got.where("rank is not null").collect()]
    assert len(kept) == 250 and sum(i % 2 for i in kept) > 200


def test_documents_are_not_exploded_for_scores(spark):
    scored = spark.createDataFrame([([1, 2],)], "b array<int>").select(importance.weight(F.col("b"), [5] * 10).alias("x"))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan and "split(" not in plan and scored.first()[0] == 5


def test_query_equals_its_sql(spark, sf_dir="/root/testdata/sf0.001"):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as from '{sf_dir}/{t}.parquet'")
    want = con.execute(importance.OP13_SQL).fetchall()
    assert order(importance.op13_importance(spark, sf_dir).collect()) == order(want)
