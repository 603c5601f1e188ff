import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from fernglass.functions import text as rules

CLEANED = {
    "Osmanthus": "osmanthus", "Oak": "oak", "Japanese Brunnera": "Japanese unnera", "Lamb's Ear": "Lamb' Ear", "Ferns": "", "Tree": "", "Native": "", "Lavender #5 (sun)": "Lavender",
    "Shrubs - Azalea": "Azalea", "Azalea - new": "Azalea", "Camellia x williamsii": "Camellia x williamsii", "Hosta 3 gal": "Hosta", "Boxwood 18\" o.c.": "Boxwood", "Hosta (deer resistant)": "Hosta",
    "Hosta (TAKE OUT)": "Hosta", "Hosta [5] {x}": "Hosta", "Hosta qty. 12": "Hosta", "Hosta 10x": "Hosta lox", "Holly, EH": "Holly", "| ris": "ris", "1ris": "lris", "": "", "Rhododendron spp.": "Rhododendron spp",
    "Ilex crenata 5T. FR— Shrubs": "Ilex crenata", "Hosta  blue": "Hosta blue",
}
VALID = {"Azalea": True, "azalea": False, "AZALEA": True, "Az": False, "Aza": False, "Az alea": False, "This plant": False, "Form white": False, "Azalea [x]": False, "Butter and Sugar": False, "A B C D": False, "Is si": False, "Azal 123456789": False, "Oak tree": True, None: False, "": False, "Sincere": False}
CORES = {"Carex elata 'Bowles Golden'": "Carex elata", "Dwarf Boxwood": "Boxwood", "Ivy 'Gold'": "Ivy 'Gold'", "": ""}


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.o for r in df.select("i", f(F.col("t")).alias("o")).orderBy("i").collect()]


def test_clean(spark):
    assert dict(zip(CLEANED, column(spark, CLEANED, rules.clean), strict=True)) == CLEANED
    assert column(spark, [None], rules.clean) == [""]


def test_valid(spark):
    assert dict(zip(VALID, column(spark, VALID, rules.valid), strict=True)) == VALID


def test_core(spark):
    assert dict(zip(CORES, column(spark, CORES, rules.core), strict=True)) == CORES


@pytest.mark.parametrize("text,want", [("a\n", "a"), (" a﻿", "a"), (" \t", "")])
def test_trimmed(spark, text, want):
    assert column(spark, [text], rules.trimmed) == [want]


def test_skipped_rules_change_nothing(spark):
    rng = random.Random(9)
    parts = ["Azalea", "1", "12", "x3", "3x", "qty", "5 gal", "#7", "-", "–", ":", "(sun)", "(3)", "[2]", "[a]", "{b}", "»", ".", " .", "AB", "BR", "2T.", "FR-", "Shrubs", "new", "native", "  ", "\t", "a", "0ak", "l|", "6' o.c.", "10 ft", "é", " "]
    df = spark.createDataFrame([("".join(rng.choice(parts) + rng.choice(("", " ", " ")) for _ in range(rng.randrange(1, 9))),) for _ in range(3000)], "t string")
    plain = rules.trimmed(reduce(lambda c, r: rules.rewrite(c, *r), rules.REWRITES, F.col("t")))
    assert df.where(rules.clean(F.col("t")) != plain).count() == 0


def test_fused_patterns_reject_what_each_rejects(spark):
    rng = random.Random(4)
    heads = ["Form", "form", "formal", "Type x", "var. x", "variegated", "sp", "spp.", "OR", "Orchid", "-x", "(x", "7 x", "abc d", "Ab cd", "See", "seed", "legend", "Butter  and x", "Butter andy", "Azalea"]
    tails = ["", " cere", "cere", " EH x", " eh", "EH", " x\n", "cere\n", " and"]
    df = spark.createDataFrame([(rng.choice(heads) + rng.choice(tails),) for _ in range(1500)], "t string")
    one, each = (reduce(lambda a, b: a | b, (F.col("t").rlike(p) for p in some)) for some in (rules._fused(rules.REJECTED), [rules.java(p, fold) for p, fold in rules.REJECTED]))
    assert df.where(one != each).count() == 0 and 0 < df.where(one).count() < 1500


def test_rewrites_at_the_ends_are_the_patterns(spark):
    from itertools import product

    cases = ["".join(p) for n in range(5) for p in product("a.-;  ", repeat=n)] + ["a– ", "﻿: a", "x\n.\n"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    for i, f in rules.AT_ENDS.items():
        wrong = df.where(f(F.col("t")) != rules.rewrite(F.col("t"), *rules.REWRITES[i]))
        assert wrong.collect() == [], i
    plain = rf"\A[{rules.SPACES}]+|[{rules.SPACES}]+\z"
    assert df.where(rules.trimmed(F.col("t")) != F.regexp_replace("t", plain, "")).collect() == []
