"""Names to dictionary rows, in stages: exact, contained, botanical, first word, similar, genus. The first stage that hits
wins; within a stage the dictionary's order does.

Distinct names are resolved once and joined back. Every stage is an equi join, so a name meets only the rows that it shares a key with and the dictionary may be large:

* contained (3): a key of at least 0.6 of a name's length is one of the name's parts of such lengths; a name of more than `SHORT` characters is met by
  the 8 characters in its middle, which any such key covers;
* botanical (4): beginnings of the name; and the four letters on either side of a space for the first two words;
* first word (5): that word;
* similar (6): the first three letters and a length at most 2 apart.

Rows that a stage can't tell apart (equal keys, botanical names or first words) count once, with the first in order. What the keys bring together is then compared exactly.
Null keys and botanical names meet nothing; empty and null names are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernglass.functions import text as rules
from fernglass.operators.components import checkpointed

SHORT = 64


def similar_enough(a: Column, b: Column) -> Column:
    """Lengths at most 2 apart, at least 0.8 of the shorter's characters (0.9 below 5) somewhere in the longer, and the same
    first three characters of the shorter. At equal length b is the shorter."""
    la, lb = F.char_length(a), F.char_length(b)
    short, long = F.when(la < lb, a).otherwise(b), F.when(la < lb, b).otherwise(a)
    chars = F.filter(F.split(short, ""), lambda c: c != "")
    share = F.try_divide(F.size(F.filter(chars, lambda c: F.contains(long, c))), F.char_length(short))
    least = F.when(F.char_length(short) < 5, F.lit(0.9)).otherwise(F.lit(0.8))
    return F.coalesce((F.abs(la - lb) <= 2) & (share >= least) & F.startswith(long, F.substring(short, 1, 3)), F.lit(False))


def _parts(c: Column, low: Column, high: Column) -> Column:
    """All parts of a text whose lengths are from low to high."""
    n = F.char_length(c)
    of = lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(c, i, size))
    return F.when(low <= high, F.flatten(F.transform(F.sequence(low, F.greatest(low, high)), of)))


def _first(rows: DataFrame, by: str | Column) -> DataFrame:
    """(t, ord, k) of the first row in order for each text t."""
    return rows.select((F.col(by) if isinstance(by, str) else by).alias("t"), "ord", "k").where("t is not null").groupBy("t").agg(F.min(F.struct("ord", "k")).alias("m")).select("t", "m.ord", "m.k")


def contained(names: DataFrame, dim: DataFrame) -> DataFrame:
    """(name_, ord, k) of names (name_, key_) that contain a key (ord, k) of at least 0.6 of their length."""
    keys = _first(dim, "k")
    longest = keys.agg(F.max(F.char_length("t"))).first()[0] or 0
    n, enough = F.char_length("key_"), F.char_length("k") >= F.char_length("key_") * 0.6
    low = F.floor(n * 0.6).cast("int")
    short = names.where(n <= SHORT).select("name_", "key_", F.explode(F.array_distinct(_parts(F.col("key_"), low, F.least(n, F.lit(longest))))).alias("t"))
    found = short.join(keys, "t").where(enough).select("name_", "ord", "k")
    if longest < SHORT * 0.6:
        return found
    middle = names.where(n > SHORT).where(n * 0.6 <= longest).select("name_", "key_", F.substring(F.col("key_"), F.ceil(n * 0.4).cast("int") + 1, F.lit(8)).alias("g"))
    grams = keys.where(F.char_length("t") > SHORT * 0.6 - 1).select("ord", "k", F.explode(F.array_distinct(_parts(F.col("t"), F.lit(8), F.lit(8)))).alias("g"))
    return found.unionByName(middle.join(grams, "g").where(enough & F.contains("key_", F.col("k"))).select("name_", "ord", "k"))


def by_botanical(names: DataFrame, dim: DataFrame) -> DataFrame:
    """(name_, ord, k) of names (name_, t: cleaned or as written) that begin with a botanical name, or contain its first two words."""
    rows = dim.select("ord", "k", F.lower("botanical").alias("bot"))
    whole = _first(rows, "bot")
    sizes = sorted(r.n for r in whole.select(F.char_length("t").alias("n")).distinct().collect())  # as many as there are lengths of a name
    starts = F.transform(F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: n <= F.char_length("t")), lambda n: F.substring(F.col("t"), F.lit(1), n))
    found = names.select("name_", F.explode(starts).alias("t")).join(whole, "t").select("name_", "ord", "k")
    words = F.split("bot", " ")
    pairs = _first(rows.where(F.size(words) >= 2), F.array_join(F.slice(words, 1, 2), " ")).withColumns({"two": F.col("t"), "l": F.split("t", " ")[0], "r": F.split("t", " ")[1]})
    pairs = pairs.select("two", "ord", "k", F.substring(F.col("l"), F.greatest(F.lit(1), F.char_length("l") - 3), F.lit(4)).alias("l"), F.substring("r", 1, 4).alias("r"))
    kinds = pairs.select(F.char_length("l").alias("a"), F.char_length("r").alias("b")).distinct().collect()  # 25 at most
    split = F.split("t", " ")
    gaps = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(split) - 1)), lambda i: F.struct(F.element_at(split, i).alias("l"), F.try_element_at(split, i + 1).alias("r")))
    spaced = names.where(F.size(split) >= 2).select("name_", "t", F.explode(gaps).alias("g")).select("name_", "t", "g.l", "g.r")
    near = F.array(*(F.when((F.char_length("l") >= a) & (F.char_length("r") >= b), F.struct(F.right("l", F.lit(a)).alias("l"), F.left("r", F.lit(b)).alias("r"))) for a, b in kinds))
    spaced = spaced.select("name_", "t", F.explode(F.filter(near, lambda x: x.isNotNull())).alias("x")).select("name_", "t", "x.l", "x.r").distinct() if kinds else spaced.limit(0)
    return found.unionByName(spaced.join(pairs, ["l", "r"]).where(F.contains("t", F.col("two"))).select("name_", "ord", "k"))


def by_first_word(names: DataFrame, dim: DataFrame) -> DataFrame:
    """(name_, ord, k) of names (name_, key_) whose first word of more than two letters begins a key of several words."""
    word = F.try_element_at(F.filter(F.split("key_", f"[{rules.SPACES}]+"), lambda w: F.char_length(w) > 2), F.lit(1))
    several = _first(dim.where(F.contains("k", F.lit(" "))), F.element_at(F.split("k", " "), 1))
    return names.select("name_", word.alias("t")).join(several, "t").select("name_", "ord", "k")


def similar(names: DataFrame, dim: DataFrame) -> DataFrame:
    """(name_, ord, k) of names (name_, key_) and keys that are similar enough; of equal keys the first in order."""
    keys = _first(dim, "k")
    n = F.char_length("key_")
    sizes = F.filter(F.sequence(n - 2, n + 2), lambda m: m > 0)
    asked = names.where(n > 0).select("name_", "key_", F.explode(sizes).alias("m")).withColumn("p", F.least(F.lit(3), n, F.col("m"))).withColumn("s", F.substring(F.col("key_"), F.lit(1), F.col("p")))
    there = keys.where(F.char_length("t") > 0).select("ord", "k", F.char_length("t").alias("m"), F.explode(F.sequence(F.lit(1), F.least(F.lit(3), F.char_length("t")))).alias("p")).withColumn("s", F.substring(F.col("k"), F.lit(1), F.col("p")))
    return asked.join(there, ["m", "p", "s"]).where(similar_enough(F.col("key_"), F.col("k"))).select("name_", "ord", "k")


def botanical_part(name: Column) -> Column:
    """A name before its cultivar or dash."""
    cut = rules.trimmed(name)
    cut = rules.trimmed(F.when(F.instr(cut, "'") > 1, F.substring_index(cut, "'", 1)).otherwise(cut))
    return rules.trimmed(F.when(F.instr(cut, " - ") > 1, F.substring_index(cut, " - ", 1)).otherwise(cut))


def genus_words(name: Column) -> Column:
    return F.split(F.lower(botanical_part(name)), f"[{rules.SPACES}]+")


def genus_lookup(names: DataFrame, genera: DataFrame, name: str = "name") -> DataFrame:
    """(name, genus) of the first word that is a genus."""
    words = names.select(name).distinct().select(name, F.posexplode(genus_words(F.col(name))).alias("pos", "genus"))
    return words.join(genera.select("genus"), "genus").groupBy(name).agg(F.min_by("genus", "pos").alias("genus"))


def lookup(names: DataFrame, plants: DataFrame, genera: DataFrame, name: str = "name") -> DataFrame:
    """(name, stage, key, genus) for each distinct non-empty name; stage is null where nothing was found."""
    dim = plants.select("ord", F.col("key").alias("k"), "botanical")
    lower = lambda c: rules.trimmed(F.lower(c))
    rows = names.select(F.col(name).alias("name_")).where("name_ != ''").distinct().withColumns({"key_": lower(rules.core(F.col("name_"))), "orig_": lower(F.col("name_"))})
    rows = checkpointed(rows)  # each rewritten name serves the plans below
    keys = _first(dim, "k")
    exact = [rows.join(keys, F.col(c) == F.col("t")).select("name_", F.lit(n).alias("stage"), "ord", "k") for n, c in ((1, "key_"), (2, "orig_"))]
    best = lambda found: found.groupBy("name_").agg(F.min(F.struct("stage", "ord", "k")).alias("hit"))
    exact = checkpointed(best(reduce(DataFrame.unionByName, exact)))
    rest = rows.join(exact, "name_", "left_anti")
    written = rest.select("name_", F.explode(F.array_distinct(F.array("key_", "orig_"))).alias("t"))
    loose = [contained(rest, dim), by_botanical(written, dim), by_first_word(rest, dim), similar(rest, dim)]
    loose = best(reduce(DataFrame.unionByName, [found.withColumn("stage", F.lit(n)) for n, found in enumerate(loose, 3)]))
    hits = checkpointed(exact.unionByName(loose)).select("name_", "hit.stage", F.col("hit.k").alias("key"))
    by_genus = genus_lookup(rows.join(hits, "name_", "left_anti").select("name_"), genera, "name_")
    out = rows.select("name_").join(hits, "name_", "left").join(by_genus, "name_", "left")
    return out.select(F.col("name_").alias(name), F.when(F.col("genus").isNotNull(), 7).otherwise(F.col("stage")).alias("stage"), "key", "genus")


def enriched(rows: DataFrame, plants: DataFrame, genera: DataFrame, name: str = "name") -> DataFrame:
    """rows with the eight plant attributes of their names; without a hit common is the name and the others ''."""
    found = lookup(rows, plants, genera, name)
    attrs = ("common", "botanical", "type", "size", "bloom", "sun", "water", "notes")
    p = plants.select("key", *(F.col(a).alias(f"__plant_{a}") for a in attrs))
    g = genera.select("genus", *(F.col(a).alias(f"__genus_{a}") for a in ("type", "sun", "water", "bloom", "notes")))
    out = rows.join(found, name, "left").join(p, "key", "left").join(g, "genus", "left")
    own = {"common": rules.trimmed(F.col(name)), "botanical": F.when(F.col("genus").isNotNull(), botanical_part(F.col(name)))}
    value = lambda a: F.coalesce(F.nullif(F.col(f"__plant_{a}"), F.lit("")), own[a] if a in own else F.col(f"__genus_{a}") if f"__genus_{a}" in g.columns else F.lit(None), F.lit(""))
    return out.select(*(rows[c] for c in rows.columns if c not in attrs), "stage", *(value(a).alias(a) for a in attrs))
