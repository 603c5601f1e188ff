"""Queries over records: lookups, upserts, cascades, feedback, listings, geometry, photo urls, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.functions import viewport
from fernglass.operators import markers, media, raster, state
from fernglass.plans.images import FOUND_PARTITION, LEAST, NEAR, REGIONS, TOLERANCE
from fernglass.sources import dims, tables


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.table(spark, sf_dir, name)


def legend_left_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as markers, parts as legend: the part's name, or the flag where there is no such part."""
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 3).alias("key"), "l_returnflag")
    out = state.left_lookup(rows, _t(spark, sf_dir, "part").select("p_partkey", "p_name"), "key", "p_partkey", "p_name")
    return out.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.coalesce("p_name", "l_returnflag").alias("shown"))


LEGEND_LEFT_LOOKUP = "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, coalesce(p_name, l_returnflag) AS shown FROM lineitem LEFT JOIN part ON p_partkey = l_partkey * 3"


def first_match_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to the first part of their segment's first word, letters' case aside."""
    dim = _t(spark, sf_dir, "part").select("p_partkey", F.upper("p_type").alias("kind"))
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, ("economy", "Small", "none", "PROMO"))), (F.col("c_custkey") % 4 + 1).cast("int")).alias("want"))
    return state.left_lookup(rows, dim, "want", "kind", "p_partkey", fold=True).select("c_custkey", "want", "p_partkey")


FIRST_MATCH_LOOKUP = "WITH d AS (SELECT lower(p_type) AS k, min(p_partkey) AS p_partkey FROM part GROUP BY 1), c AS (SELECT c_custkey, ['economy', 'Small', 'none', 'PROMO'][c_custkey % 4 + 1] AS want FROM customer) SELECT c_custkey, want, p_partkey FROM c LEFT JOIN d ON lower(want) = k"


def suggestions_union_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _t(spark, sf_dir, "part").where("p_size < 10").select(F.upper("p_name").alias("name"))
    return state.unlisted(_t(spark, sf_dir, "part").select(F.col("p_name").alias("name")), listed)


SUGGESTIONS_UNION_ANTI = "WITH l AS (SELECT upper(p_name) AS name FROM part WHERE p_size < 10) SELECT name, 'listed' AS origin FROM l UNION ALL SELECT p_name, 'rest' FROM part WHERE lower(p_name) NOT IN (SELECT lower(name) FROM l)"


def cascade_delete_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return state.without(_t(spark, sf_dir, "lineitem"), gone, "l_orderkey").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey")


CASCADE_DELETE_ANTI = "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rating = F.when(F.col("event_type") == "view", "correct").when(F.col("event_type") == "click", "close").when(F.col("event_type") == "error", "wrong").when(F.col("event_type") == "signup", "duplicate")
    return _t(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("marker_id"), "ts", rating.alias("rating"), (F.col("event_type") == "purchase").alias("is_missing"))


def feedback_latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest(feedback(spark, sf_dir), "marker_id", "ts", "event_id").select("marker_id", "event_id", "rating", "is_missing")


_FEEDBACK = "f AS (SELECT event_id, user_id::VARCHAR AS marker_id, ts, CASE event_type WHEN 'view' THEN 'correct' WHEN 'click' THEN 'close' WHEN 'error' THEN 'wrong' WHEN 'signup' THEN 'duplicate' END AS rating, event_type = 'purchase' AS is_missing FROM events)"
FEEDBACK_LATEST_UPSERT = f"WITH {_FEEDBACK}, r AS (SELECT *, row_number() OVER (PARTITION BY marker_id ORDER BY ts DESC, event_id DESC) AS n FROM f) SELECT marker_id, event_id, rating, is_missing FROM r WHERE n = 1"


def feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.feedback_summary(feedback(spark, sf_dir))


FEEDBACK_SUMMARY = f"WITH {_FEEDBACK} SELECT {', '.join(f'''count(*) FILTER (rating = '{r}')::BIGINT AS {r}''' for r in ('correct', 'close', 'wrong', 'duplicate'))}, count(*) FILTER (is_missing)::BIGINT AS missing FROM f"


def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored customers, those of nation 3 put again with a new balance."""
    stored = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = _t(spark, sf_dir, "customer").where("c_nationkey = 3").select("c_custkey", "c_name", F.lit(0.5).alias("c_acctbal"))
    return state.upserted(stored, new, "c_custkey")


KEYED_UPSERT = "SELECT c_custkey, c_name, CASE WHEN c_nationkey = 3 THEN 0.5::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer"


def keyed_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").where("c_custkey = 42").select("c_custkey", "c_name", "c_mktsegment")


KEYED_GET = "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 42"


def saved_list_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as saved images: lines of even parts as markers, of odd ones as annotations."""
    lines = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.when(F.col("l_partkey") % 2 == 0, F.col("l_linenumber"))).alias("markers"), F.collect_list(F.when(F.col("l_partkey") % 2 == 1, F.col("l_linenumber"))).alias("annotations"))
    saved = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("plan "), F.col("o_orderkey")).alias("name"), F.col("o_orderdate").alias("saved_at")).join(lines, "id", "left")
    return state.recent(saved).select("id", "name", F.col("n_annotations").cast("long").alias("n_annotations"), F.col("n_markers").cast("long").alias("n_markers"))


SAVED_LIST_RECENT = "WITH l AS (SELECT l_orderkey AS id, count(*) FILTER (l_partkey % 2 = 0) AS m, count(*) FILTER (l_partkey % 2 = 1) AS a FROM lineitem GROUP BY 1) SELECT o_orderkey AS id, 'plan ' || o_orderkey AS name, coalesce(a, 0)::BIGINT AS n_annotations, coalesce(m, 0)::BIGINT AS n_markers FROM orders LEFT JOIN l ON id = o_orderkey ORDER BY o_orderdate DESC, o_orderkey"


def next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.next_id(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")))


NEXT_ID = "SELECT (coalesce(max(o_orderkey), 0) + 1)::BIGINT AS next_id FROM orders"


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


JSON_PROPS = "SELECT event_id, (props->>'$.k')::BIGINT AS k, props->>'$.missing' AS missing FROM events"


def default_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The idiom of empty-or-null defaults, and the choice of a search name."""
    botanical = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.when(F.col("p_size") % 3 == 1, F.col("p_type")))
    return _t(spark, sf_dir, "part").select("p_partkey", state.default(botanical, state.default(F.lit(None).cast("string"), F.col("p_name"))).alias("search_name"))


DEFAULT_TEXTS = "SELECT p_partkey, coalesce(nullif(CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN p_type END, ''), p_name) AS search_name FROM part"


def confirmed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("image_id"), F.col("p_partkey").alias("ord"), F.when(F.col("p_size") > 5, F.col("p_name")).otherwise("").alias("name"), F.when(F.col("p_size") < 45, F.col("p_size")).alias("cr"))
    return state.confirmed(rows).select("image_id", "ord", "name", F.col("id").cast("long").alias("id"), F.col("count").cast("long").alias("count"))


CONFIRMED_ENTRIES = "SELECT p_brand AS image_id, p_partkey AS ord, p_name AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::BIGINT AS id, 0::BIGINT AS count FROM part WHERE p_size > 5 AND p_size < 45"


def low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").groupBy("p_brand").agg(F.floor(F.avg("p_size") * 2 + 10.5).alias("confidence")).withColumn("low", state.low_confidence(F.col("confidence")))


LOW_CONFIDENCE = "SELECT p_brand, floor(avg(p_size) * 2 + 10.5)::BIGINT AS confidence, floor(avg(p_size) * 2 + 10.5) < 60 AS low FROM part GROUP BY 1"


def marker_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """While annotating only annotations show, else both kinds."""
    both = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", "annotation").otherwise("marker").alias("kind"), F.explode(F.array(F.lit(True), F.lit(False))).alias("annotating"))
    return both.where(state.visible(F.col("kind"), F.col("annotating"))).groupBy("annotating", "kind").agg(F.count("*").alias("n"))


MARKER_VISIBILITY = "WITH e AS (SELECT CASE WHEN event_type = 'click' THEN 'annotation' ELSE 'marker' END AS kind, unnest([true, false]) AS annotating FROM events) SELECT annotating, kind, count(*)::BIGINT AS n FROM e WHERE kind = 'annotation' OR NOT annotating GROUP BY ALL"


def viewport_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").withColumn("scale", 0.05 + F.col("user_id") / 50.0).withColumn("offset", F.col("event_id") % 100)
    image = viewport.to_image(F.col("value"), F.lit(8), F.col("offset"), F.col("scale"))
    return e.select("event_id", F.round(image, 6).alias("image_x"), F.round(viewport.to_screen(image, F.col("scale"), F.col("offset")), 6).alias("screen_x"), F.round(viewport.marker_scale(F.col("scale")), 6).alias("marker"))


VIEWPORT_TRANSFORM = "WITH e AS (SELECT event_id, value, 0.05::DOUBLE + user_id / 50.0::DOUBLE AS scale, event_id % 100 AS off FROM events) SELECT event_id, round((value - 8 - off) / scale, 6) AS image_x, round((value - 8 - off) / scale * scale + off, 6) AS screen_x, round(least(1.0::DOUBLE, 1 / scale), 6) AS marker FROM e"


def zoom_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").withColumn("scale", F.col("value") / 10)
    after = viewport.zoomed(F.col("scale"), F.when(F.col("event_type") == "click", 1.15).otherwise(1 / 1.15))
    return e.where("scale > 0").select("event_id", F.round(after, 6).alias("scale"), F.round(viewport.anchored(F.lit(10.0), F.lit(200.0), F.col("scale"), after), 6).alias("offset"))


ZOOM_CLAMP = "WITH e AS (SELECT event_id, value / 10 AS s, CASE WHEN event_type = 'click' THEN 1.15::DOUBLE ELSE 1 / 1.15::DOUBLE END AS f FROM events WHERE value / 10 > 0), z AS (SELECT event_id, s, greatest(0.05::DOUBLE, least(20.0::DOUBLE, s * f)) AS t FROM e) SELECT event_id, round(t, 6) AS scale, round(200.0::DOUBLE - (200.0::DOUBLE - 10.0::DOUBLE) * (t / s), 6) AS \"offset\" FROM z"


def crop_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_id", (F.col("value") - 5).alias("x1"), (F.col("user_id") * 0.7).alias("y1"), (F.col("event_id") % 90).alias("x2"), F.col("value").alias("y2"))
    x, y, w, h = viewport.rectangle(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    out = viewport.cropped(x, y, w, h, F.lit(64), F.lit(48))
    return e.where(viewport.crop_accepted(w, h)).select("event_id", *(c.cast("long").alias(n) for c, n in zip(out, ("x", "y", "w", "h"), strict=True)))


CROP_CLAMP = "WITH e AS (SELECT event_id, value - 5 AS x1, user_id * 0.7::DOUBLE AS y1, event_id % 90 AS x2, value AS y2 FROM events), r AS (SELECT event_id, least(x1, x2) AS l, least(y1, y2) AS t, abs(x2 - x1) AS w, abs(y2 - y1) AS h FROM e), c AS (SELECT *, greatest(0, floor(l + 0.5)) AS cx, greatest(0, floor(t + 0.5)) AS cy FROM r WHERE w > 10 AND h > 10) SELECT event_id, cx::BIGINT AS x, cy::BIGINT AS y, least(64 - cx, floor(w + 0.5))::BIGINT AS w, least(48 - cy, floor(h + 0.5))::BIGINT AS h FROM c"


def thumb_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = viewport.thumbnail(F.col("p_size") * 10, F.col("p_retailprice"))
    scale, left, top = viewport.fit(F.col("p_size") * 10, F.col("p_retailprice"), F.lit(800.0), F.lit(600.0))
    return _t(spark, sf_dir, "part").select("p_partkey", w.cast("long").alias("w"), h.cast("long").alias("h"), *(F.round(c, 6).alias(n) for c, n in ((scale, "scale"), (left, "left"), (top, "top"))))


THUMB_RATIO = "WITH p AS (SELECT p_partkey, p_size * 10 AS w, p_retailprice AS h, least(120 / (p_size * 10)::DOUBLE, 120 / p_retailprice) AS r, least(800.0::DOUBLE / (p_size * 10), 600.0::DOUBLE / p_retailprice) * 0.95::DOUBLE AS s FROM part) SELECT p_partkey, floor(w * r)::BIGINT AS w, floor(h * r)::BIGINT AS h, round(s, 6) AS scale, round((800.0::DOUBLE - w * s) / 2, 6) AS \"left\", round((600.0::DOUBLE - h * s) / 2, 6) AS top FROM p"


def media_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as search hits: by the last part of the host, three terms, the path's number as title."""
    p = _t(spark, sf_dir, "pages")
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1)
    word = F.element_at(F.array(*map(F.lit, ("flower", "map", "plan", "Logo", "bloom", "leaf"))), (F.col("page_id") % 6 + 1).cast("int"))
    return p.select((F.col("page_id") % 20).alias("search_name"), (F.floor(F.col("page_id") / 20) % 3).alias("term_idx"), F.col("page_id").alias("hit_idx"), F.concat(word, path).alias("title"), F.concat(F.lit("/220px-"), word, path).alias("url"))


_HITS = r"h AS (SELECT page_id % 20 AS search_name, (page_id // 20) % 3 AS term_idx, page_id AS hit_idx, ['flower', 'map', 'plan', 'Logo', 'bloom', 'leaf'][page_id % 6 + 1] || regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS title FROM pages), hits AS (SELECT *, '/220px-' || title AS url FROM h)"


def url_filter_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.hits_until_enough(media_hits(spark, sf_dir)).withColumn("url", media.resized(F.col("url")))


_KEPT = f"{_HITS}, k AS (SELECT * FROM hits WHERE NOT regexp_matches(lower(title), 'icon|map|logo|flag')), o AS (SELECT *, row_number() OVER (PARTITION BY search_name, url ORDER BY term_idx, hit_idx) AS n FROM k), d AS (SELECT * FROM o WHERE n = 1), c AS (SELECT search_name, term_idx, count(*) AS c FROM d GROUP BY ALL), b AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY search_name ORDER BY term_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c), e AS (SELECT d.search_name, d.term_idx, hit_idx, regexp_replace(url, '/[0-9]+px-', '/800px-') AS url FROM d JOIN b USING (search_name, term_idx) WHERE before < 6)"
URL_FILTER_DEDUPE = f"WITH {_KEPT} SELECT search_name, term_idx::BIGINT AS term_idx, hit_idx, url FROM e"


def url_categorize_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = url_filter_dedupe(spark, sf_dir).withColumn("ord", F.struct("term_idx", "hit_idx"))
    out = media.photos(rows)
    return out.select("search_name", F.array_join("closeup", " ").alias("closeup"), F.array_join("full", " ").alias("full"))


URL_CATEGORIZE_REBALANCE = f"""
WITH {_KEPT}, g AS (SELECT search_name, list(url ORDER BY term_idx, hit_idx) FILTER (regexp_matches(lower(url), 'flower|bloom|detail|close')) AS c0, list(url ORDER BY term_idx, hit_idx) FILTER (NOT regexp_matches(lower(url), 'flower|bloom|detail|close')) AS f0 FROM e GROUP BY 1
), z AS (SELECT search_name, coalesce(c0, []) AS c, coalesce(f0, []) AS f FROM g
), m AS (SELECT search_name, CASE WHEN len(c) = 0 AND len(f) > 1 THEN [f[len(f)]] WHEN len(f) = 0 AND len(c) > 1 THEN c[1:len(c)-1] ELSE c END AS c, CASE WHEN len(f) = 0 AND len(c) > 1 THEN [c[len(c)]] WHEN len(c) = 0 AND len(f) > 1 THEN f[1:len(f)-1] ELSE f END AS f FROM z)
SELECT search_name, array_to_string(c[1:3], ' ') AS closeup, array_to_string(f[1:3], ' ') AS "full" FROM m
"""


def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export in rows: a head (the palette with its hits, totals and the feedback's counts), and each marker's latest feedback.

    The feedback grows with the input, so it is not gathered into the head: the rows with the part `feedback` are the elements
    of its list, by marker_id."""
    from fernglass.plans.images import found_partition

    legend = found_partition(spark, sf_dir).agg(F.array_sort(F.collect_list(F.struct("id", "name", F.lit("").alias("color"), F.col("hits").alias("count")))).alias("legend"), F.sum("hits").alias("markers"))
    counts = feedback_summary(spark, sf_dir).select(F.struct("*").alias("summary"))
    last = feedback_latest_upsert(spark, sf_dir)
    one = legend.crossJoin(counts).crossJoin(last.agg(F.count("*").alias("feedback")))  # one row each
    head = state.export_json(F.lit("plan.png"), F.lit(40), F.lit("2024-01-01T00:00:00.000Z"), F.col("legend"), F.lit(None).cast("array<string>"), F.struct("markers", "feedback"), F.col("summary"))
    rows = last.select(F.lit("feedback").alias("part"), "marker_id", F.to_json(F.struct("marker_id", "rating")).alias("json"))
    return one.select(F.lit("head").alias("part"), F.lit(None).cast("string").alias("marker_id"), head.alias("json")).unionByName(rows)


_ENTRY = "'{' || chr(10) || '    \"id\" : ' || id || ',' || chr(10) || '    \"name\" : \"' || name || '\",' || chr(10) || '    \"color\" : \"\",' || chr(10) || '    \"count\" : ' || hits || chr(10) || '  }'"
_COUNTS = " || ',' || chr(10) || ".join(f"'    \"{r}\" : ' || {r}" for r in ("correct", "close", "wrong", "duplicate", "missing"))
EXPORT_JSON = f"""
WITH p AS ({FOUND_PARTITION}), s AS ({FEEDBACK_SUMMARY}), l AS ({FEEDBACK_LATEST_UPSERT})
SELECT 'head' AS part, NULL::VARCHAR AS marker_id, '{{' || chr(10) || '  "exportDate" : "2024-01-01T00:00:00.000Z",' || chr(10) || '  "imageFilename" : "plan.png",' || chr(10) || '  "colorTolerance" : 40,' || chr(10) ||
  '  "legendEntries" : [ ' || (SELECT string_agg({_ENTRY}, ', ' ORDER BY id) FROM p) || ' ],' || chr(10) || '  "totalMarkers" : ' || (SELECT sum(hits) FROM p) || ',' || chr(10) || '  "feedbackCount" : ' || (SELECT count(*) FROM l) || ',' || chr(10) ||
  '  "summary" : {{' || chr(10) || {_COUNTS} || chr(10) || '  }}' || chr(10) || '}}' AS json FROM s
UNION ALL SELECT 'feedback', marker_id, '{{"marker_id":"' || marker_id || '"' || coalesce(',"rating":"' || rating || '"', '') || '}}' FROM l
"""


def export_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export as one document in lines: palette and hits, every marker's latest feedback with its nine fields, and the summary."""
    from fernglass.plans.images import found_partition

    legend = found_partition(spark, sf_dir).agg(F.array_sort(F.collect_list(F.struct("id", "name", F.lit("").alias("color"), F.col("hits").alias("count")))).alias("legend"), F.sum("hits").alias("markers"))
    last = state.latest(feedback(spark, sf_dir), "marker_id", "ts", "event_id").join(_t(spark, sf_dir, "events").select("event_id", "value"), "event_id")
    p = F.broadcast(tables.palette(spark).select(F.col("id").alias("color_id"), F.col("name").alias("detectedName"), F.array("r", "g", "b").alias("detectedColor")))
    rows = last.withColumn("color_id", (F.col("event_id") % 3 + 1).cast("int")).join(p, "color_id")
    whole = lambda c: F.floor(c + 0.5).cast("long")
    rows = rows.select(F.col("marker_id").alias("markerId"), state.iso_time(F.col("ts")).alias("timestamp"), "rating", "detectedName", "detectedColor", F.struct(whole(F.col("value")).alias("x"), (F.col("event_id") % 64).alias("y")).alias("position"),
        F.when(F.col("rating") == "wrong", "Rust").otherwise("").alias("correctName"), F.lit("").alias("notes"), F.col("is_missing").alias("isMissing"))
    head = legend.crossJoin(feedback_summary(spark, sf_dir).select(F.struct("*").alias("summary"))).crossJoin(last.agg(F.count("*").alias("feedback_count")))  # one row each
    head = head.withColumns({"filename": F.lit("plan.png"), "tolerance": F.lit(40), "date": F.lit("2024-01-01T00:00:00.000Z")})
    return state.export_lines(head, rows).withColumn("part", F.col("part").cast("long"))


EXPORT_DOCUMENT = f"""
WITH p AS ({FOUND_PARTITION}), s AS ({FEEDBACK_SUMMARY}), l AS ({FEEDBACK_LATEST_UPSERT}), n AS (SELECT * FROM (VALUES (0, 'middle gray', '[128,128,128]'), (1, 'rust', '[160,128,96]'), (2, 'slate', '[96,128,160]')) AS t(c, name, rgb)
), f AS (SELECT l.*, e.ts, e.value, n.name, n.rgb FROM l JOIN events e USING (event_id) JOIN n ON c = event_id % 3)
SELECT 0::BIGINT AS part, NULL::VARCHAR AS marker_id, '{{"exportDate":"2024-01-01T00:00:00.000Z","imageFilename":"plan.png","colorTolerance":40,"legendEntries":[' ||
  (SELECT string_agg('{{"id":' || id || ',"name":"' || name || '","color":"","count":' || hits || '}}', ',' ORDER BY id) FROM p) || '],"totalMarkers":' || (SELECT sum(hits) FROM p) || ',"feedbackCount":' || (SELECT count(*) FROM l) || ',"feedback":[' AS line
UNION ALL SELECT 1, marker_id, CASE WHEN marker_id = (SELECT min(marker_id) FROM l) THEN '' ELSE ',' END || '{{"markerId":"' || marker_id || '","timestamp":"' || strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z","rating":' || coalesce('"' || rating || '"', 'null') ||
  ',"detectedName":"' || name || '","detectedColor":' || rgb || ',"position":{{"x":' || floor(value + 0.5)::BIGINT || ',"y":' || event_id % 64 || '}},"correctName":"' || CASE WHEN rating = 'wrong' THEN 'Rust' ELSE '' END || '","notes":"","isMissing":' || is_missing || '}}' FROM f
UNION ALL SELECT 2, NULL, '],"summary":{{"correct":' || correct || ',"close":' || close || ',"wrong":' || wrong || ',"duplicate":' || duplicate || ',"missing":' || missing || '}}}}' FROM s
"""


def annotations_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points, named after plants, a palette colour or nothing."""
    d = F.broadcast(dims.plants(spark).select("ord", F.upper("common").alias("common")))
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("point_id"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), (F.col("event_id") % 48).cast("int").alias("ord"), "event_type").join(d, "ord")
    name = F.when(F.col("event_type") == "view", F.concat(F.lit(" "), F.col("common"), F.lit("\t"))).when(F.col("event_type") == "click", "Rust").when(F.col("event_type") == "error", "  ").otherwise("no such plant")
    out = markers.annotated(e.select("point_id", "x", "y", name.alias("name")), tables.palette(spark), dims.plants(spark), dims.genera(spark))
    return out.select("point_id", "id", "name", F.col("color_id").cast("long").alias("color_id"), "common", "botanical", "sun")


_KNOWN = ", ".join("(" + ", ".join([str(r[0])] + ["'" + r[i].replace("'", "''") + "'" for i in (2, 3, 7)]) + ")" for r in dims.plant_rows())
ANNOTATIONS_CREATED = f"""
WITH p AS (SELECT * FROM (VALUES {_KNOWN}) AS t(ord, common, botanical, sun)), e AS (
  SELECT event_id AS point_id, CASE event_type WHEN 'view' THEN upper(common) WHEN 'click' THEN 'Rust' WHEN 'error' THEN '' ELSE 'no such plant' END AS name, event_type = 'view' AS known, common, botanical, sun FROM events JOIN p ON event_id % 48 = ord
) SELECT point_id, row_number() OVER (ORDER BY point_id)::BIGINT AS id, name, CASE WHEN name = 'Rust' THEN 2 END::BIGINT AS color_id,
  CASE WHEN known THEN common ELSE name END AS common, CASE WHEN known THEN botanical ELSE '' END AS botanical, CASE WHEN known THEN sun ELSE '' END AS sun FROM e WHERE name <> ''
"""


def record_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records; those of nation 7 get new attributes and lose their photos."""
    attrs = {a: F.concat(F.lit(f"{a} "), F.col("c_mktsegment")) for a in markers.ATTRIBUTES}
    rows = _t(spark, sf_dir, "customer").withColumn("id", F.col("c_custkey")).withColumns(attrs).withColumns({"photos": F.array("c_name"), "photos_fetched": F.lit(True)})
    edits = rows.where("c_nationkey = 7").select("id", *(F.upper(a).alias(a) for a in markers.ATTRIBUTES))
    return markers.edited(rows, edits).select("id", "common", "notes", F.size("photos").cast("long").alias("n_photos"), "photos_fetched")


RECORD_EDITS = "SELECT c_custkey AS id, CASE WHEN c_nationkey = 7 THEN upper('common ' || c_mktsegment) ELSE 'common ' || c_mktsegment END AS common, CASE WHEN c_nationkey = 7 THEN upper('notes ' || c_mktsegment) ELSE 'notes ' || c_mktsegment END AS notes, (c_nationkey <> 7)::BIGINT AS n_photos, c_nationkey <> 7 AS photos_fetched FROM customer"


def plant_type_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [*markers.TYPE_LABELS, "moss"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("p_partkey") % len(kinds) + 1).cast("int"))
    return _t(spark, sf_dir, "part").select("p_partkey", markers.type_label(kind).alias("label"))


_LABELS = [*markers.TYPE_LABELS.values()]
PLANT_TYPE_LABELS = f"SELECT p_partkey, [{', '.join(f"'{v}'" for v in _LABELS)}, NULL][p_partkey % {len(_LABELS) + 1} + 1] AS label FROM part"


def missing_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = {"corner_x": 4, "corner_y": 8, "offset_x": 1, "offset_y": 2, "scale": 0.5}
    clicks = _t(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("at_ms"), F.col("value").alias("client_x"), F.col("user_id").alias("client_y"), *(F.lit(v).alias(n) for n, v in fixed.items()))
    return markers.missing_stub(clicks).select("marker_id", F.col("position.x").cast("long").alias("x"), F.col("position.y").cast("long").alias("y"), "is_missing")


MISSING_STUBS = "SELECT 'missing_' || event_id AS marker_id, floor((value - 5) / 0.5::DOUBLE + 0.5)::BIGINT AS x, floor((user_id - 10) / 0.5::DOUBLE + 0.5)::BIGINT AS y, true AS is_missing FROM events WHERE event_type = 'error'"


def request_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searches for part names with odd characters and spaces around, encoded."""
    rows = _t(spark, sf_dir, "part").select(F.concat(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), "p_name")), F.lit(" & (~é!'*) "), "p_brand").alias("search_name"))
    return media.search_terms(rows).select("search_name", F.col("term_idx").cast("long").alias("term_idx"), media.encoded(F.col("term")).alias("term"))


REQUEST_TERMS = """
WITH n AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE ' ' || p_name END || ' & (~é!''*) ' || p_brand AS name FROM part
), f AS (SELECT trim(lower(name)) AS search_name, min(name) AS name FROM n GROUP BY 1
), t AS (SELECT search_name, unnest([0, 1, 2])::BIGINT AS term_idx, unnest([name, name || ' plant', name || ' flower']) AS term FROM f)
SELECT search_name, term_idx, replace(replace(replace(replace(replace(url_encode(term), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*') AS term FROM t
"""


def photos_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The photos of names out of landed answers: for every page a name with a summary and three searches, whose JSON is made of the page's number."""
    p = _t(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("n"), F.col("page_id").cast("string")).alias("search_name"))
    n = F.col("page_id")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    summary = F.when(n % 3 == 0, text('{"thumbnail":{"source":"https://u/', n, '/320px-flower.jpg"},"originalimage":{"source":"https://u/', n, '/o.jpg"}}')).when(n % 3 == 1, "{}").otherwise("no json")
    page = lambda key, title, url: text('"', key, '":{"title":"', title, '","imageinfo":[{"url":"https://c/', url, '"}]}')
    searches = p.select("page_id", "search_name", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("term_idx"))
    t = F.col("term_idx")
    body = F.when((n % 7 == 0) & (t == 1), "oops").when((n % 5 == 0) & (t == 0), F.lit(None).cast("string")).otherwise(text(
        '{"query":{"pages":{', page(n + 20, F.lit("A"), text(n % 4, "/close", t)), ",", page(F.lit("-1"), F.lit("Map of B"), text(n, "/b", t)), ",", page(n + 3, F.lit("C"), text(n, "/c")), ",", page(F.lit("x"), F.lit("D"), text(n, "/d", t % (n % 3 + 1))), "}}}",
    ))
    found = media.fetched(p.select("search_name", summary.alias("body")), searches.select("search_name", "term_idx", body.alias("body")))
    return media.all_photos(found).join(found, "search_name").select("search_name", F.array_join("closeup", " ").alias("closeup"), F.array_join("full", " ").alias("full"), F.array_join("photos", " ").alias("photos"))


PHOTOS_FETCHED = """
WITH p AS (SELECT page_id AS n, 'n' || page_id AS search_name FROM pages
), s AS (SELECT *, CASE WHEN n % 3 = 0 THEN ['https://u/' || n || '/800px-flower.jpg', 'https://u/' || n || '/o.jpg'] ELSE [] END AS known FROM p
), a AS (
  SELECT n, search_name, t, unnest([0, 1, 2, 3]) AS h FROM (SELECT n, search_name, unnest([0, 1, 2]) AS t FROM p) WHERE NOT (n % 5 = 0 AND t = 0) AND NOT (n % 7 = 0 AND t >= 1)
), u AS (
  SELECT *, 'https://c/' || CASE h WHEN 0 THEN n || '/c' WHEN 1 THEN (n % 4) || '/close' || t WHEN 2 THEN n || '/b' || t ELSE n || '/d' || (t % (n % 3 + 1)) END AS url FROM a WHERE h <> 2
), d AS (SELECT n, search_name, url, min(t * 10 + h) AS ord FROM u GROUP BY ALL
), c AS (SELECT n, search_name, ord // 10 AS t, count(*) AS c FROM d GROUP BY ALL
), b AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY search_name ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c
), e AS (SELECT d.search_name, url, ord FROM d JOIN b ON d.search_name = b.search_name AND d.ord // 10 = b.t WHERE before < 6
), l AS (SELECT search_name, list(url ORDER BY ord) FILTER (contains(url, 'close')) AS c0, list(url ORDER BY ord) FILTER (NOT contains(url, 'close')) AS f0 FROM e GROUP BY 1
), z AS (SELECT search_name, coalesce(c0, []) AS c, list_concat(known, coalesce(f0, [])) AS f FROM s LEFT JOIN l USING (search_name)
), m AS (SELECT search_name, CASE WHEN len(c) = 0 AND len(f) > 1 THEN [f[len(f)]] WHEN len(f) = 0 AND len(c) > 1 THEN c[1:len(c)-1] ELSE c END AS c, CASE WHEN len(f) = 0 AND len(c) > 1 THEN [c[len(c)]] WHEN len(c) = 0 AND len(f) > 1 THEN f[1:len(f)-1] ELSE f END AS f FROM z)
SELECT search_name, array_to_string(c[1:3], ' ') AS closeup, array_to_string(f[1:3], ' ') AS "full", array_to_string(list_concat(c[1:3], f[1:3]), ' ') AS photos FROM m
"""


def rescan_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of colours 1 and 9; colour 1 is scanned again."""
    palette = tables.palette(spark).where("id = 1")
    blobs = raster.regions(raster.colour_mask(tables.pixels(spark, sf_dir), palette, TOLERANCE), LEAST)
    old = _t(spark, sf_dir, "events").select(F.when(F.col("event_id") % 2 == 0, 1).otherwise(9).alias("color_id"), F.col("user_id").alias("image_id"), F.col("value").alias("x"), F.col("value").alias("y"), F.col("event_id").alias("blob_size"), F.lit("old").alias("name"))
    return markers.rescanned(old, blobs, palette).groupBy("color_id", "name").agg(F.count("*").alias("n"), F.sum("blob_size").alias("size"))


RESCAN_MARKERS = f"WITH RECURSIVE {REGIONS} SELECT 1::INTEGER AS color_id, 'middle gray' AS name, count(*)::BIGINT AS n, sum(size)::BIGINT AS size FROM blobs WHERE color_id = 1 UNION ALL SELECT 9, 'old', count(*), sum(event_id)::BIGINT FROM events WHERE event_id % 2 = 1"

def scan_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour 1, named after a plant, scanned whole: old markers of it go, new ones get ids, attributes and a count."""
    palette = tables.palette(spark).where("id = 1").withColumn("name", F.lit("Boxwood"))
    old = _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("image_id"), F.col("value").alias("x"), F.col("value").alias("y"), F.col("event_id").alias("blob_size"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(9).alias("color_id"), F.lit("old").alias("name"))
    found, counts = markers.scanned(old, tables.pixels(spark, sf_dir), palette, dims.plants(spark), dims.genera(spark), tolerance=TOLERANCE, least=LEAST, floor=1)
    n = F.broadcast(counts.select(F.col("id").alias("k_"), F.col("count").cast("long").alias("count")))  # a row for each scanned colour
    return found.join(n, F.col("color_id") == F.col("k_"), "left").select("id", F.col("color_id").cast("long").alias("color_id"), "name", F.col("blob_size").cast("long").alias("blob_size"), "botanical", "sun", "count")


_BOX = next(r for r in dims.plant_rows() if r[1] == "boxwood")
SCAN_COLOUR = f"""
WITH RECURSIVE {NEAR}, hits AS (SELECT *, row_number() OVER (ORDER BY image_id, blob_id) AS i FROM merged WHERE color_id = 1 AND greatest(max_x - min_x, max_y - min_y) / greatest(1, least(max_x - min_x, max_y - min_y))::DOUBLE < 8)
SELECT event_id AS id, 9::BIGINT AS color_id, 'old' AS name, event_id::BIGINT AS blob_size, NULL::VARCHAR AS botanical, NULL::VARCHAR AS sun, NULL::BIGINT AS count FROM events WHERE event_id % 2 <> 0
UNION ALL SELECT (SELECT max(event_id) FROM events) + i, 1, 'Boxwood', size, '{_BOX[3]}', '{_BOX[7]}', (SELECT count(*) FROM hits) FROM hits
"""


def marker_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as markers with the latest of their events as feedback."""
    m = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("marker_id"), "c_name")
    f = _t(spark, sf_dir, "events").select(F.col("user_id").alias("marker_id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("rating"), F.col("event_id").cast("string").alias("correct_name"), "event_id")
    return state.with_feedback(m, f, "marker_id", "timestamp", "event_id")


MARKER_FEEDBACK = "WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT c_custkey AS marker_id, c_name, event_type AS rating, event_id::VARCHAR AS correct_name, 'debug-' || event_type AS shown_as FROM customer LEFT JOIN f ON user_id = c_custkey AND n = 1"


def shown_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", state.iso_time(F.col("ts")).alias("iso"), state.shown_time(F.col("ts")).alias("shown"))


SHOWN_TIMES = "SELECT event_id, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, strftime(ts, '%-m/%-d/%Y %I:%M %p') AS shown FROM events"


def display_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of parts: their own, a short list, or the palette's."""
    p, b = _t(spark, sf_dir, "part"), F.col("p_size").cast("int")
    own = F.when(F.col("p_partkey") % 3 == 0, F.array(b, b + 1, b + 2)).when(F.col("p_partkey") % 3 == 1, F.array(b, b))
    entry = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit(128), F.lit(96), b, b))
    return p.select("p_partkey", state.display_colour(own, entry).alias("shown"))


DISPLAY_COLOURS = "WITH c AS (SELECT p_partkey, coalesce(CASE p_partkey % 3 WHEN 0 THEN [p_size, p_size + 1, p_size + 2] WHEN 1 THEN [p_size, p_size] END, CASE WHEN p_partkey % 2 = 0 THEN [128, 96, p_size, p_size] END) AS c FROM part) SELECT p_partkey, CASE WHEN len(c) >= 3 THEN 'rgb(' || array_to_string(c[1:3], ',') || ')' END AS shown FROM c"


def legend_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entries of legends: the new palettes, and how many markers (events) their images lose."""
    rows = _t(spark, sf_dir, "part").select((F.col("p_size") % 7).alias("image_id"), F.col("p_partkey").alias("ord"), F.when(F.col("p_size") > 5, F.col("p_name")).alias("name"), F.when(F.col("p_size") < 45, F.col("p_size")).alias("cr"), F.lit(1).alias("cg"), F.lit(2).alias("cb"))
    palette, images = state.legend_palette(rows)
    left = state.without(_t(spark, sf_dir, "events").select((F.col("event_id") % 9).cast("int").alias("image_id")), images, "image_id").groupBy("image_id").agg(F.count("*").alias("n"))
    kept = left.agg(F.sum("n").alias("markers_left"))
    return palette.crossJoin(kept).select("image_id", F.col("id").cast("long").alias("id"), "name", "db_key", "cr", "markers_left")  # one row


LEGEND_CONFIRMED = "WITH e AS (SELECT p_size % 7 AS image_id, row_number() OVER (PARTITION BY p_size % 7 ORDER BY p_partkey) AS id, p_name AS name, p_size AS cr FROM part WHERE p_size > 5 AND p_size < 45) SELECT image_id, id::BIGINT AS id, name, lower(name) AS db_key, cr, (SELECT count(*) FROM events WHERE event_id % 9 NOT IN (SELECT p_size % 7 FROM part))::BIGINT AS markers_left FROM e"


_NAMES = ("export_json", "export_document", "scan_colour", "marker_feedback", "shown_times", "display_colours", "legend_confirmed", "annotations_created", "record_edits", "plant_type_labels", "missing_stubs", "request_terms", "photos_fetched", "rescan_markers", "legend_left_lookup", "first_match_lookup", "suggestions_union_anti", "cascade_delete_anti", "feedback_latest_upsert", "feedback_summary", "keyed_upsert", "keyed_get", "saved_list_recent", "next_id", "json_props", "default_texts", "confirmed_entries", "low_confidence", "marker_visibility", "viewport_transform", "zoom_clamp", "crop_clamp", "thumb_ratio", "url_filter_dedupe", "url_categorize_rebalance")
QUERIES = {n: globals()[n] for n in _NAMES}
ORACLES = {n: globals()[n.upper()] for n in _NAMES}
