from pyspark.sql import functions as F

from fernglass.operators import layout

SWATCH = "image_id string, idx int, blob_id long, cr long, cg long, cb long, min_x long, max_x long, min_y long, max_y long"
WORD = "image_id string, word_idx int, text string, confidence double, x0 int, y0 int, x1 int, y1 int"


def legend(spark):
    swatches = spark.createDataFrame([("i", 0, 0, 1, 1, 1, 10, 30, 10, 30), ("i", 1, 1, 2, 2, 2, 150, 170, 12, 32), ("i", 2, 2, 3, 3, 3, 10, 30, 60, 80)], SWATCH)
    sizes = spark.createDataFrame([("i", 1000, 400)], "image_id string, width int, height int")
    words = spark.createDataFrame([
        ("i", 0, "Blue", 90.0, 40, 15, 70, 27), ("i", 1, "Fescue", 80.0, 75, 15, 110, 27), ("i", 2, "Azalea", 70.0, 180, 15, 220, 27), ("i", 3, "far", 70.0, 290, 15, 310, 27),
        ("i", 4, "azal", 50.0, 40, 62, 60, 74), ("i", 5, "gap", 50.0, 130, 62, 150, 74), ("i", 6, "below", 50.0, 40, 200, 60, 212),
    ], WORD)
    return swatches, sizes, words


def test_words_go_to_one_swatch(spark):
    swatches, sizes, words = legend(spark)
    bounded = layout.right_boundaries(swatches, sizes)
    assert sorted((r.ord, r.right_boundary) for r in bounded.collect()) == [(0, 145.0), (1, 320.0), (2, 180.0)]
    got = sorted((r.ord, r.word_idx, r.place) for r in layout.assign_words(bounded, words).collect())
    assert got == [(0, 0, 0), (0, 1, 1), (1, 2, 0), (2, 4, 0)]
    entries = sorted((r.ord, r.name, r.confidence, r.cr) for r in layout.parse(swatches, sizes, words).collect())
    assert entries == [(0, "Blue Fescue", 85, 1), (1, "Azalea", 70, 2)]
    found = layout.named(layout.assign_words(bounded, words), words)
    counts = layout.parse_counts(bounded, found, layout.without_near_names(found.where("valid"))).first()
    assert tuple(counts) == ("i", 3, 0, 1, 2, 0)


def test_near_names_are_dropped_in_order(spark):
    names = ["Hosta", "hosta!", "Hostas", "Hosta blue giant", "Host", "12", "Ivy", "ivy league"]
    df = spark.createDataFrame([("i", n, t) for n, t in enumerate(names)], "image_id string, ord int, name string")
    kept = []
    for t in names:
        p = "".join(c for c in t.lower() if "a" <= c <= "z")
        if not any(p == q or ((p.startswith(q) or q.startswith(p)) and abs(len(p) - len(q)) < 5) for _, q in kept):
            kept.append((t, p))
    assert [r.name for r in layout.without_near_names(df).orderBy("ord").collect()] == [t for t, _ in kept]
    assert layout.without_near_names(df.limit(0)).count() == 0


def test_lines_and_gaps(spark):
    words = spark.createDataFrame([("i", 0, "a", 1.0, 0, 0, 10, 10), ("i", 1, "b", 1.0, 20, 5, 30, 15), ("i", 2, "c", 1.0, 81, 7, 90, 17), ("i", 3, "d", 1.0, 0, 30, 10, 40)], WORD)
    assert {r.word_idx: r.line for r in layout.lines_of_words(words, 10).collect()} == {0: 0, 1: 0, 2: 1, 3: 2}
    assert {r.word_idx: r.line for r in layout.lines_of_words(words.withColumn("h", F.lit(20.0)), "h").collect()} == {0: 0, 1: 0, 2: 0, 3: 1}
    # Middles count, not tops, and words stay in their own order.
    tall = spark.createDataFrame([("i", 0, "a", 1.0, 0, 0, 10, 40), ("i", 1, "b", 1.0, 20, 16, 30, 24), ("i", 2, "c", 1.0, 9, 60, 10, 70), ("i", 3, "d", 1.0, 9, 18, 10, 22)], WORD)
    assert {r.word_idx: r.line for r in layout.lines_of_words(tall, 10).collect()} == {0: 0, 1: 0, 2: 1, 3: 2}
    assert layout.lines_of_words(words.limit(0), 10).count() == 0
    assert sorted(r.word_idx for r in layout.gap_cut(words.where(F.col("word_idx") < 3), ("image_id",)).collect()) == [0, 1]
