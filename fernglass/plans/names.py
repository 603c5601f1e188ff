"""Queries over lines of text and plant names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.functions import text as rules
from fernglass.operators import layout, legend, resolve, state
from fernglass.plans import images as drawings
from fernglass.sources import dims, tables
from fernglass.sources.tables import LINES_SQL


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.lines(spark, sf_dir).select("doc_id", "pos", rules.clean(F.col("line")).alias("cleaned"))


CLEAN_LINES = f"WITH {LINES_SQL} SELECT doc_id, pos::BIGINT AS pos, {rules.sql_clean('line')} AS cleaned FROM lines"


def valid_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned lines and their first two words, tested as names."""
    rows = clean_lines(spark, sf_dir).withColumn("short", F.array_join(F.slice(F.split("cleaned", " "), 1, 2), " "))
    return rows.select("doc_id", "pos", rules.valid(F.col("cleaned")).alias("line_valid"), rules.valid(F.col("short")).alias("short_valid"))


VALID_NAMES = f"WITH c AS ({CLEAN_LINES}), s AS (SELECT *, array_to_string(string_split(cleaned, ' ')[1:2], ' ') AS short FROM c) SELECT doc_id, pos, {rules.sql_valid('cleaned')} AS line_valid, {rules.sql_valid('short')} AS short_valid FROM s"


def core_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(spark, sf_dir).select("doc_id", "pos", rules.core_of(F.col("cleaned")).alias("core"))


CORE_NAMES = f"WITH c AS ({CLEAN_LINES}) SELECT doc_id, pos, {rules.sql_core_of('cleaned')} AS core FROM c"


def import_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state.imported_lines(tables.spread(tables.table(spark, sf_dir, "documents").select("doc_id", "text")), "text", "doc_id")
    return rows.withColumn("pos", F.col("pos").cast("long"))


IMPORT_LINES = rf"WITH {LINES_SQL} SELECT doc_id, pos::BIGINT AS pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM lines WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> ''"


def import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many names a pasted text holds, in words."""
    n = import_lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"))
    return n.withColumn("label", F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " plant").otherwise(" plants")))


IMPORT_COUNTS = f"WITH i AS ({IMPORT_LINES}) SELECT doc_id, count(*)::BIGINT AS n, count(*)::VARCHAR || CASE WHEN count(*) = 1 THEN ' plant' ELSE ' plants' END AS label FROM i GROUP BY 1"


def near_dup_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines as names, without near repeats."""
    rows = tables.lines(spark, sf_dir).select("doc_id", "pos", F.col("line").alias("name"))
    return layout.without_near_names(rows, "doc_id", "pos", "name")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name for each part: a plant's, written in one of seven ways."""
    p = tables.table(spark, sf_dir, "part").select("p_partkey", "p_name", (F.col("p_partkey") % 48).cast("int").alias("ord"), (F.floor(F.col("p_partkey") / 48) % 7).alias("way"))
    d = F.broadcast(dims.plants(spark).select("ord", "common", "botanical"))
    q = F.lit("'")
    forms = (F.col("common"), F.concat("botanical", F.lit(" "), q, F.lit("Bright Star"), q), F.concat(F.lit("Dwarf "), "common"), F.concat("common", F.lit(" #5 (sun)")), F.upper("common"), F.concat(F.split("botanical", " ")[0], F.lit(" "), "p_name"), F.col("p_name"))
    name = F.when(F.col("way") == 0, forms[0])
    for i, form in enumerate(forms[1:], 1):
        name = name.when(F.col("way") == i, form)
    return p.join(d, "ord").select("p_partkey", name.alias("name"))


def _values(rows, names: str) -> str:
    quoted = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS t({names}))"


_PLANTS = _values([r[:4] for r in dims.plant_rows()], "ord, k, common, botanical")
_GENERA = _values([r[:1] for r in dims.genus_rows()], "genus")
_NAMES = f"""plants AS {_PLANTS}, genera AS {_GENERA}, names AS (
  SELECT p_partkey, CASE (p_partkey // 48) % 7 WHEN 0 THEN common WHEN 1 THEN botanical || ' ''Bright Star''' WHEN 2 THEN 'Dwarf ' || common WHEN 3 THEN common || ' #5 (sun)'
    WHEN 4 THEN upper(common) WHEN 5 THEN string_split(botanical, ' ')[1] || ' ' || p_name ELSE p_name END AS name FROM part JOIN plants ON p_partkey % 48 = ord
), uniq AS (SELECT DISTINCT name FROM names), cleaned AS (SELECT name, {rules.sql_clean('name')} AS c FROM uniq
), keys AS (SELECT name, lower({rules.sql_core_of('c')}) AS key, lower(trim(name)) AS orig FROM cleaned)"""
_PART = r"regexp_replace(regexp_replace(trim(name), '^([^'']+)''.*$', '\1'), '^(.+?) - .*$', '\1')"
_SIMILAR = (
    "(abs(length({a}) - length({b})) <= 2 AND CASE WHEN length({a}) < length({b}) THEN starts_with({b}, substr({a}, 1, 3)) ELSE starts_with({a}, substr({b}, 1, 3)) END AND "
    "len(list_filter(string_split(CASE WHEN length({a}) < length({b}) THEN {a} ELSE {b} END, ''), lambda x: x <> '' AND contains(CASE WHEN length({a}) < length({b}) THEN {b} ELSE {a} END, x))) "
    ">= CASE WHEN least(length({a}), length({b})) < 5 THEN 0.9 ELSE 0.8 END * least(length({a}), length({b})) AND least(length({a}), length({b})) > 0)"
)


def lookup_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve.lookup(names(spark, sf_dir), dims.plants(spark), dims.genera(spark))
    return names(spark, sf_dir).join(found, "name", "left").select("p_partkey", "name", F.col("stage").cast("long").alias("stage"), "key", "genus")


LOOKUP_CASCADE = f"""
WITH {_NAMES}, tried AS (
  SELECT name, ord, k, CASE WHEN key = k THEN 1 WHEN orig = k THEN 2 WHEN contains(key, k) AND length(k) >= 0.6 * length(key) THEN 3
    WHEN lower(botanical) IN (key, orig) OR starts_with(key, lower(botanical)) OR starts_with(orig, lower(botanical)) OR (len(string_split(botanical, ' ')) >= 2 AND
      (contains(key, array_to_string(string_split(lower(botanical), ' ')[1:2], ' ')) OR contains(orig, array_to_string(string_split(lower(botanical), ' ')[1:2], ' ')))) THEN 4
    WHEN contains(k, ' ') AND string_split(k, ' ')[1] = list_filter(string_split(key, ' '), lambda w: length(w) > 2)[1] THEN 5
    WHEN {_SIMILAR.format(a='key', b='k')} THEN 6 END AS stage FROM keys, plants
), hits AS (SELECT name, arg_min(k, stage * 1000 + ord) AS key, min(stage) AS stage FROM tried WHERE stage IS NOT NULL GROUP BY 1
), words AS (SELECT name, w, i FROM (SELECT name, unnest(s) AS w, generate_subscripts(s, 1) AS i FROM (SELECT name, regexp_split_to_array(lower({_PART}), '\\s+') AS s FROM uniq WHERE name NOT IN (SELECT name FROM hits)))
), gen AS (SELECT name, arg_min(w, i) AS genus FROM words JOIN genera ON w = genus GROUP BY 1)
SELECT p_partkey, name, CASE WHEN genus IS NOT NULL THEN 7 ELSE stage END::BIGINT AS stage, key, genus FROM names LEFT JOIN hits USING (name) LEFT JOIN gen USING (name)
"""


def lookup_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolve.enriched(names(spark, sf_dir), dims.plants(spark), dims.genera(spark))
    return rows.select("p_partkey", "name", "common", "type", "sun", "water")


_PLANTS_ALL = _values([(r[1], r[2], r[4], r[7], r[8]) for r in dims.plant_rows()], "key, pc, pt, ps, pw")
_GENERA_ALL = _values([r[:4] for r in dims.genus_rows()], "genus, gt, gs, gw")
LOOKUP_ENRICHED = f"WITH found AS ({LOOKUP_CASCADE}), p AS {_PLANTS_ALL}, g AS {_GENERA_ALL} SELECT p_partkey, name, coalesce(pc, trim(name)) AS common, coalesce(pt, gt, '') AS type, coalesce(ps, gs, '') AS sun, coalesce(pw, gw, '') AS water FROM found LEFT JOIN p USING (key) LEFT JOIN g USING (genus)"


def genus_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.genus_lookup(names(spark, sf_dir), dims.genera(spark))


GENUS_LOOKUP = f"WITH {_NAMES}, words AS (SELECT name, unnest(s) AS w, generate_subscripts(s, 1) AS i FROM (SELECT name, regexp_split_to_array(lower({_PART}), '\\s+') AS s FROM uniq)) SELECT name, arg_min(w, i) AS genus FROM words JOIN genera ON w = genus GROUP BY 1"


def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part names and dictionary keys (a fixed table) that are similar enough."""
    rows = names(spark, sf_dir).select(F.lower("name").alias("name_")).distinct().withColumn("key_", F.col("name_"))
    return resolve.similar(rows, dims.plants(spark).withColumnRenamed("key", "k")).select(F.col("name_").alias("name"), F.col("k").alias("key"))


SIMILAR_PAIRS = f"WITH {_NAMES}, l AS (SELECT DISTINCT lower(name) AS name FROM names) SELECT name, k AS key FROM l, plants WHERE {_SIMILAR.format(a='name', b='k')}"


def plant_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the name field offers, the dictionary's common names, and how many parts' names each stands for."""
    found = resolve.lookup(names(spark, sf_dir), dims.plants(spark), dims.genera(spark)).where("key is not null").select("name", "key")
    parts = names(spark, sf_dir).join(found, "name").groupBy("key").agg(F.count("*").alias("n"))
    return dims.plants(spark).join(parts, "key", "left").select(F.col("ord").cast("long").alias("ord"), "common", F.coalesce("n", F.lit(0)).alias("parts"))


def plant_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary's photos, one a row, for the names of parts that it knows."""
    found = resolve.lookup(names(spark, sf_dir), dims.plants(spark), dims.genera(spark)).where("key is not null")
    p = F.broadcast(dims.plants(spark).select("key", F.posexplode("photos").alias("pos", "photo")))  # the fixed dictionary
    return found.join(p, "key").select("name", F.col("pos").cast("long").alias("pos"), "photo")


PLANT_NAMES = f"SELECT ord::BIGINT AS ord, common, coalesce(n, 0)::BIGINT AS parts FROM {_PLANTS} LEFT JOIN (SELECT key, count(*) AS n FROM ({LOOKUP_CASCADE}) WHERE key IS NOT NULL GROUP BY 1) ON key = k"
_PHOTOS = _values([(r[1], i, u) for r in dims.plant_rows() for i, u in enumerate(r[-1])], "key, pos, photo")
PLANT_PHOTOS = f"SELECT DISTINCT name, pos::BIGINT AS pos, photo FROM ({LOOKUP_CASCADE}) JOIN {_PHOTOS.replace(' AS t(', ' AS t2(')} USING (key)"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the words of documents' first lines' texts as a recognizer would give them: 8 pixels a character, lines 12 high."""
    from pyspark.sql import Window

    w = tables.lines(spark, sf_dir).select("doc_id", "pos", F.posexplode(F.split("line", " ")).alias("i", "text")).where("text != ''")
    left = F.coalesce(F.sum(F.char_length("text") * 8 + 8 + F.when(F.col("i") % 9 == 8, 60).otherwise(0)).over(Window.partitionBy("doc_id", "pos").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return w.select("doc_id", "pos", F.col("i").alias("word_idx"), "text", left.alias("x0"), (left + F.char_length("text") * 8).alias("x1"))


def gap_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.gap_cut(words(spark, sf_dir), ("doc_id", "pos")).groupBy("doc_id", "pos").agg(F.count("*").alias("n"), F.max("x1").alias("right"))


GAP_CUT = f"""
WITH {LINES_SQL}, w AS (SELECT doc_id, pos, generate_subscripts(s, 1) - 1 AS i, unnest(s) AS t FROM (SELECT doc_id, pos, string_split(line, ' ') AS s FROM lines)
), b AS (SELECT doc_id, pos, i, coalesce(sum(length(t) * 8 + 8 + CASE WHEN i % 9 = 8 THEN 60 ELSE 0 END) OVER (PARTITION BY doc_id, pos ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x0, length(t) * 8 AS wd FROM w WHERE t <> ''
), c AS (SELECT *, coalesce((x0 - lag(x0 + wd) OVER (PARTITION BY doc_id, pos ORDER BY x0, i) > 50)::INT, 0) AS wide FROM b
), d AS (SELECT *, max(wide) OVER (PARTITION BY doc_id, pos ORDER BY x0, i ROWS UNBOUNDED PRECEDING) AS cut FROM c)
SELECT doc_id, pos::BIGINT AS pos, count(*)::BIGINT AS n, max(x0 + wd)::BIGINT AS "right" FROM d WHERE cut = 0 GROUP BY ALL
"""

def _legend(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Swatches, sizes and words of a legend for each brand: its parts in four columns, their names beside them."""
    from pyspark.sql import Window

    p = tables.table(spark, sf_dir, "part").withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1)
    x, y = (F.col("k") % 4) * 400 + 10, F.floor(F.col("k") / 4) * 40 + 10
    level = [(F.col("p_size") * i % 256).cast("long").alias(c) for i, c in ((5, "cr"), (7, "cg"), (11, "cb"))]
    s = p.select(F.col("p_brand").alias("image_id"), F.col("k").alias("idx"), F.col("p_partkey").alias("blob_id"), *level, x.alias("min_x"), (x + 20).alias("max_x"), y.alias("min_y"), (y + 20).alias("max_y"))
    w = p.select("p_brand", "k", x.alias("x"), y.alias("y"), F.posexplode(F.split(F.initcap("p_name"), " ")).alias("i", "text"))
    left = F.col("x") + 40 + F.col("i") * 60 + F.when(F.col("k") % 5 == 4, F.col("i") * 50).otherwise(0)
    words = w.select(F.col("p_brand").alias("image_id"), (F.col("k") * 10 + F.col("i")).cast("int").alias("word_idx"), "text", (F.lit(50.0) + F.col("k") % 50).alias("confidence"), *(c.cast("int").alias(n) for c, n in ((left, "x0"), (F.col("y") + 4, "y0"), (left + 50, "x1"), (F.col("y") + 16, "y1"))))
    return s, s.select("image_id").distinct().withColumn("width", F.lit(1600)), words


def word_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, sizes, words = _legend(spark, sf_dir)
    return layout.assign_words(layout.right_boundaries(s, sizes), words).select("image_id", *(F.col(c).cast("long").alias(c) for c in ("ord", "word_idx", "place")))


_LEGEND = """
p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part
), o AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY floor(((k // 4) * 40 + 10) / 25), (k % 4) * 400 + 10, k) - 1 AS ord FROM p
), w AS (SELECT p_brand AS image_id, ord, k, unnest(string_split(p_name, ' ')) AS t, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS i FROM o
), a AS (SELECT *, 50 + k % 50 AS confidence FROM w WHERE (i = 0 OR k % 5 <> 4) AND 40 + i * 60 <= 20 + 240)"""
WORD_ASSIGNMENT = f"WITH {_LEGEND} SELECT image_id, ord::BIGINT AS ord, (k * 10 + i)::BIGINT AS word_idx, i::BIGINT AS place FROM a"


def legend_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, sizes, words = _legend(spark, sf_dir)
    return layout.named(layout.assign_words(layout.right_boundaries(s, sizes), words), words).select("image_id", F.col("ord").cast("long").alias("ord"), "raw", "name", "confidence", "valid")


_NAMED = f"{_LEGEND}, r AS (SELECT image_id, ord, string_agg(upper(t[1]) || t[2:], ' ' ORDER BY i) AS raw, floor(avg(confidence) + 0.5)::BIGINT AS confidence FROM a GROUP BY ALL), n AS (SELECT image_id, ord::BIGINT AS ord, raw, {rules.sql_clean('raw')} AS name, confidence FROM r)"
LEGEND_NAMES = f"WITH {_NAMED} SELECT *, {rules.sql_valid('name')} AS valid FROM n"
_FOLD = (
    "list_reduce(list_transform({all}, lambda e: [e]), lambda acc, e: CASE WHEN len(list_filter(acc, lambda k: k.p = e[1].p OR ((starts_with(k.p, e[1].p) OR starts_with(e[1].p, k.p)) "
    "AND abs(length(k.p) - length(e[1].p)) < 5))) > 0 THEN acc ELSE list_concat(acc, e) END)"
)


def legend_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole parse of the legends."""
    return layout.parse(*_legend(spark, sf_dir)).select("image_id", F.col("ord").cast("long").alias("ord"), "name", "confidence", F.col("cr").cast("long").alias("cr"))


LEGEND_ENTRIES = f"""
WITH {_NAMED}, v AS (SELECT * FROM n WHERE {rules.sql_valid('name')}
), l AS (SELECT image_id, list({{'o': ord, 'p': regexp_replace(lower(name), '[^a-z]', '', 'g'), 'n': name, 'c': confidence}} ORDER BY ord) AS items FROM v GROUP BY 1
), f AS (SELECT image_id, unnest({_FOLD.format(all='items')}) AS e FROM l)
SELECT f.image_id, e.o AS ord, e.n AS name, e.c AS confidence, (p_size * 5 % 256)::BIGINT AS cr FROM f JOIN o ON o.p_brand = f.image_id AND o.ord = e.o
"""


def legend_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each legend's swatches, and how many had no text, were rejected, are valid and repeat others."""
    s, sizes, words = _legend(spark, sf_dir)
    bounded = layout.right_boundaries(s, sizes)
    found = layout.named(layout.assign_words(bounded, words), words)
    rows = layout.parse_counts(bounded, found, layout.without_near_names(found.where("valid")))
    return rows.select("image_id", *(F.col(c).cast("long").alias(c) for c in rows.columns[1:]))


LEGEND_COUNTS = f"""
WITH e AS ({LEGEND_ENTRIES.strip()}), k AS (SELECT image_id, count(*) AS kept FROM e GROUP BY 1), x AS ({LEGEND_NAMES}), c AS (SELECT image_id, count(*) AS named, count(*) FILTER (NOT valid) AS rejected, count(*) FILTER (valid) AS valid FROM x GROUP BY 1
), s AS (SELECT p_brand AS image_id, count(*) AS swatches FROM part GROUP BY 1)
SELECT image_id, swatches::BIGINT AS swatches, (swatches - coalesce(named, 0))::BIGINT AS no_text, coalesce(rejected, 0)::BIGINT AS rejected, coalesce(valid, 0)::BIGINT AS valid, (coalesce(valid, 0) - coalesce(kept, 0))::BIGINT AS deduped FROM s LEFT JOIN c USING (image_id) LEFT JOIN k USING (image_id)
"""


def legend_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole parses of drawn legends, from pixels and words to entries with templates: by swatches, by rows where all boxes are gray (brands divisible by 7), and
    without names where recognition failed (brands divisible by 5)."""
    from pyspark.sql import Window

    p = tables.table(spark, sf_dir, "part").withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1)
    right, y = F.col("k") % 4 * 60 + 8 + F.when(F.col("p_partkey") % 5 == 0, 28).otherwise(12) + F.col("p_size") % 5, F.floor(F.col("k") / 4) * 30 + 8
    w = p.select("p_brand", "k", right.alias("right"), y.alias("y"), F.posexplode(F.split(F.initcap("p_name"), " ")).alias("i", "text")).where("i < 2")
    left = F.col("right") + 3 + F.col("i") * 9
    words = w.select(F.col("p_brand").alias("image_id"), (F.col("k") * 10 + F.col("i")).cast("int").alias("word_idx"), "text", (F.lit(50.0) + F.col("k") % 50).alias("confidence"), *(c.cast("int").alias(n) for c, n in ((left, "x0"), (F.col("y") + 2, "y0"), (left + 8, "x1"), (F.col("y") + 10, "y1"))))
    failed = p.where(F.substring("p_brand", 7, 9).cast("int") % 5 == 0).select(F.col("p_brand").alias("image_id")).distinct()
    found = legend.parse(drawings.drawn(spark, sf_dir, True), words, failed, tables.SIDE)
    whole = ("ord", "confidence", "cr", "cg", "cb", "min_x", "max_x", "min_y", "max_y", "y_start", "y_end")
    return found.select("image_id", "name", *(F.col(c).cast("long").alias(c) for c in whole), F.col("template.width").cast("long").alias("width"), F.col("template.height").cast("long").alias("height"))


# From the parts alone: swatches as they are detected, their words, and bands of gray boxes.
LEGEND_PARSED = f"""
WITH d AS ({drawings.SWATCHES_DETECTED.strip()}), p AS (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k, p_brand[7:]::INT AS number, p_partkey % 7 + 9 AS h FROM part
), o AS (
  SELECT d.*, k, p_name, number, row_number() OVER (PARTITION BY image_id ORDER BY floor(min_y / 25), min_x, idx) - 1 AS ord FROM d JOIN p ON image_id = p_brand AND min_x = k % 4 * 60 + 8 AND min_y = k // 4 * 30 + 8 WHERE number % 7 <> 0
), w AS (SELECT p_brand, k, number, i, upper(t[1]) || t[2:] AS t FROM (SELECT p_brand, k, number, unnest(string_split(p_name, ' ')[1:2]) AS t, generate_subscripts(string_split(p_name, ' ')[1:2], 1) AS i FROM p)
), r AS (SELECT o.image_id, o.ord, o.k, string_agg(t, ' ' ORDER BY i) AS raw FROM o JOIN w ON w.p_brand = o.image_id AND w.k = o.k WHERE o.number % 5 <> 0 GROUP BY ALL
), n AS (SELECT image_id, ord, k, {rules.sql_clean('raw')} AS name FROM r
), v AS (SELECT * FROM n WHERE {rules.sql_valid('name')}
), l AS (SELECT image_id, list({{'o': ord, 'p': regexp_replace(lower(name), '[^a-z]', '', 'g'), 'n': name, 'c': 50 + k % 50}} ORDER BY ord) AS items FROM v GROUP BY 1
), f AS (SELECT image_id, unnest({_FOLD.format(all='items')}) AS e FROM l
), named AS (SELECT image_id, e.o AS ord, e.n AS name, e.c AS confidence FROM f UNION ALL SELECT image_id, ord, '', 0 FROM o WHERE number % 5 = 0
), one AS (
  SELECT image_id, name, ord, confidence, cr, cg, cb, min_x, max_x, min_y, max_y, NULL::BIGINT AS y_start, NULL::BIGINT AS y_end, max_x - min_x AS width, max_y - min_y AS height FROM named JOIN o USING (image_id, ord)
), bands AS (SELECT image_id, number, line, line * 30 + 8 AS y_start, line * 30 + 9 + h AS y_end FROM (SELECT p_brand AS image_id, number, k // 4 AS line, max(h) AS h FROM p WHERE number % 7 = 0 GROUP BY ALL)
), read AS (
  SELECT b.image_id, y_start, y_end, b.number, {rules.sql_clean("trim(coalesce(raw, ''))")} AS name, confidence
  FROM (
    SELECT b.image_id, y_start, y_end, b.number, string_agg(t, ' ' ORDER BY w.k, i) AS raw, coalesce(floor(avg(50 + w.k % 50) + 0.5), 0) AS confidence
    FROM bands b LEFT JOIN w ON w.p_brand = b.image_id AND w.k // 4 = line AND w.k % 4 > 0 AND b.number % 5 <> 0 GROUP BY b.image_id, y_start, y_end, b.number
  ) b
), two AS (
  SELECT image_id, name, y_start AS ord, confidence, 128 AS cr, 128 AS cg, 128 AS cb, NULL::BIGINT AS min_x, NULL::BIGINT AS max_x, NULL::BIGINT AS min_y, NULL::BIGINT AS max_y, y_start, y_end, y_end - y_start AS width, y_end - y_start AS height
  FROM read WHERE number % 5 = 0 OR length(name) >= 2
)
SELECT image_id, name, {', '.join(f'{c}::BIGINT AS {c}' for c in ('ord', 'confidence', 'cr', 'cg', 'cb', 'min_x', 'max_x', 'min_y', 'max_y', 'y_start', 'y_end', 'width', 'height'))} FROM (SELECT * FROM one UNION ALL SELECT * FROM two)
"""


def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the legends' words, whose tops are uneven."""
    words = _legend(spark, sf_dir)[2]
    shift = F.col("word_idx") * 7 % 9
    rows = layout.lines_of_words(words.withColumns({"y0": F.col("y0") + shift, "y1": F.col("y1") + shift}), 12)
    return rows.select("image_id", F.col("word_idx").cast("long").alias("word_idx"), F.col("line").cast("long").alias("line"))


WORD_LINES = """
WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part
), w AS (SELECT p_brand AS image_id, k, k * 10 + generate_subscripts(string_split(p_name, ' '), 1) - 1 AS word_idx FROM p
), l AS (SELECT image_id, list(word_idx ORDER BY word_idx) AS w, list((k // 4) * 40 + 20 + word_idx * 7 % 9 ORDER BY word_idx) AS m FROM w GROUP BY 1
), st AS (
  SELECT image_id, w, m, 1 AS i, 0 AS line, m[1] AS first FROM l
  UNION ALL SELECT image_id, w, m, i + 1, CASE WHEN abs(m[i + 1] - first) >= 12 * 0.6::DOUBLE THEN line + 1 ELSE line END, CASE WHEN abs(m[i + 1] - first) >= 12 * 0.6::DOUBLE THEN m[i + 1] ELSE first END FROM st WHERE i < len(m)
) SELECT image_id, w[i]::BIGINT AS word_idx, line::BIGINT AS line FROM st
"""
NEAR_DUP_NAMES = f"""
WITH {LINES_SQL}, s AS (SELECT doc_id, pos, line AS n FROM lines
), l AS (SELECT doc_id, list({{'o': pos::BIGINT, 'p': regexp_replace(lower(n), '[^a-z]', '', 'g'), 'n': n}} ORDER BY pos) AS items FROM s GROUP BY 1
), f AS (SELECT doc_id, unnest({_FOLD.format(all='items')}) AS e FROM l)
SELECT doc_id, e.o AS pos, e.n AS name FROM f
"""

QUERIES = {f.__name__: f for f in (clean_lines, valid_names, core_names, import_lines, import_counts, near_dup_names, lookup_cascade, lookup_enriched, genus_lookup, similar_pairs, plant_names, plant_photos, gap_cut, word_assignment, legend_names, legend_entries, legend_counts, legend_parsed, word_lines)}
ORACLES = {n.lower(): globals()[n] for n in ("CLEAN_LINES", "VALID_NAMES", "CORE_NAMES", "IMPORT_LINES", "IMPORT_COUNTS", "LOOKUP_CASCADE", "LOOKUP_ENRICHED", "GENUS_LOOKUP", "SIMILAR_PAIRS", "PLANT_NAMES", "PLANT_PHOTOS", "GAP_CUT", "WORD_ASSIGNMENT", "LEGEND_NAMES", "LEGEND_ENTRIES", "NEAR_DUP_NAMES", "LEGEND_COUNTS", "LEGEND_PARSED", "WORD_LINES")}
