import random

from pyspark.sql import functions as F

from fernglass.operators import resolve
from fernglass.sources import dims

WANT = {
    "Boxwood": (1, "boxwood"), "Dwarf Boxwood": (1, "boxwood"), "privy": (3, "ivy"), "Rhododendron spp.": (3, "rhododendron"), "Rhododendron spp. hybrids": (4, "azalea"),
    "Buxus sempervirens 'Green Gem'": (4, "boxwood"), "Japanese xyz": (5, "japanese maple"), "Boxwod": (6, "boxwood"), "Quercus alba": (7, None), "An Acer 'Bloodgood'": (7, None), "Nothing at all": (None, None), "Prunus laurocerasus - x": (7, None),
}


def test_stages(spark):
    names = spark.createDataFrame([(n,) for n in [*WANT, "", None]] + [("Boxwood",)], "name string")
    got = {r.name: (r.stage, r.key) for r in resolve.lookup(names, dims.plants(spark), dims.genera(spark)).collect()}
    assert got == WANT
    assert resolve.lookup(names.limit(0), dims.plants(spark), dims.genera(spark)).count() == 0


def test_enriched(spark):
    rows = spark.createDataFrame([(1, "Boxwood"), (2, "Prunus x 'Snow'"), (3, "nothing")], "id int, name string")
    got = {r.id: r for r in resolve.enriched(rows, dims.plants(spark), dims.genera(spark)).collect()}
    assert (got[1].botanical, got[1].sun) == ("Buxus sempervirens", "full-sun")
    assert (got[2].common, got[2].botanical, got[2].type) == ("Prunus x 'Snow'", "Prunus x", "evergreen-shrub")
    assert (got[3].common, got[3].botanical, got[3].stage) == ("nothing", "", None)


def test_similar_enough_is_not_symmetric(spark):
    def plain(a, b):
        short, long = (a, b) if len(a) < len(b) else (b, a)
        if abs(len(a) - len(b)) > 2 or not short:
            return False
        return sum(c in long for c in short) / len(short) >= (0.9 if len(short) < 5 else 0.8) and long.startswith(short[:3])

    words = ["hosta", "hostas", "hsota", "hos", "host", "aabbc", "aabbd", "aab", "", "boxwood", "boxwod"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in df.select("a", "b", resolve.similar_enough(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.s == plain(r.a, r.b), (r.a, r.b)


def test_dimensions():
    plants, genera = dims.plant_rows(), {r[0]: r for r in dims.genus_rows()}
    assert len(plants) == 48 and len(genera) == 171 and genera["prunus"][1] == "evergreen-shrub" and genera["hydrangea"][1] == "vine"
    assert all(len(r) == 11 and all(v != "" for v in r[1:10]) for r in plants)


def plain_stage(key, orig, k, bot):
    """The stage at which one row is met, rule by rule."""
    bot, n = bot.lower(), len(key)
    two = " ".join(bot.split(" ")[:2])
    if key == k:
        return 1
    if orig == k:
        return 2
    if k in key and len(k) >= n * 0.6:
        return 3
    if bot in (key, orig) or key.startswith(bot) or orig.startswith(bot) or len(bot.split(" ")) >= 2 and (two in key or two in orig):
        return 4
    words = [w for w in key.split() if len(w) > 2]
    if " " in k and words and k.split(" ")[0] == words[0]:
        return 5
    short, long = (key, k) if n < len(k) else (k, key)
    if abs(n - len(k)) <= 2 and short and sum(c in long for c in short) / len(short) >= (0.9 if len(short) < 5 else 0.8) and long.startswith(short[:3]):
        return 6
    return None


DIM = "ord int, key string, botanical string"


def test_equal_to_comparing_all_rows(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choices("abcd", k=n))
    phrase = lambda: " ".join(word(r.randint(1, 6)) for _ in range(r.randint(1, 4)))
    plants = [(i, phrase(), phrase().title()) for i in range(150)] + [(150, "ab", "A  B"), (151, "long " * 30 + "name", "Very long botanical " * 9), (152, "ab", "Abc Abd")]
    asked = {phrase() for _ in range(300)} | {p[1][: r.randint(1, 9)] + word(2) for p in plants} | {p[2].lower() + " x" for p in plants} | {"x " + p[2].lower() for p in plants} | {"q" * 40 + " " + "long " * 30 + "name" + "z" * 30, "long " * 30 + "name"}
    rows = [(n, n, n) for n in sorted(asked)]
    frame = spark.createDataFrame(rows, "name_ string, key_ string, orig_ string").cache()
    dim = spark.createDataFrame(plants, DIM).withColumnRenamed("key", "k").cache()
    best = {}
    written = frame.withColumn("t", F.col("key_"))
    for n, found in enumerate((resolve.contained(frame, dim), resolve.by_botanical(written, dim), resolve.by_first_word(frame, dim), resolve.similar(frame, dim)), 3):
        for x in found.collect():
            best[x.name_] = min(best.get(x.name_, (9, 0, "")), (n, x.ord, x.k))
    for name, _, _ in rows:
        hits = [(s, o, k) for o, k, b in plants if (s := plain_stage(name, name, k, b)) and s > 2]
        exact = any(k == name for _, k, _ in plants)
        assert exact or min(hits, default=(9, 0, "")) == best.get(name, (9, 0, "")), name


def test_hundred_thousand_rows_without_a_nested_loop(spark):
    plants = spark.range(100_000).select(F.col("id").cast("int").alias("ord"), F.concat(F.lit("plant k"), F.col("id").cast("string"), F.lit(" of the garden")).alias("key"), F.concat(F.lit("Genus"), F.col("id").cast("string"), F.lit(" species")).alias("botanical"))
    names = spark.range(0, 100_000, 50).select(F.when(F.col("id") % 100 == 0, F.concat(F.lit("the plant k"), F.col("id").cast("string"), F.lit(" of the garden"))).otherwise(F.concat(F.lit("genus"), F.col("id").cast("string"), F.lit(" species x"))).alias("name"))
    genera = spark.createDataFrame([("quercus",)], "genus string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = resolve.lookup(names, plants, genera)
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert len(rows) == 2000 and {r.stage for r in rows} == {3, 4}
    assert all(r.key == (r.name.removeprefix("the ") if r.stage == 3 else f"plant k{r.name[5:].split()[0]} of the garden") for r in rows)
