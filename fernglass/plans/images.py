"""Queries over the rasters: masks, regions, bands, swatches' steps, templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernglass.functions import text as rules
from fernglass.operators import layout, legend, raster, state, swatches, templates, tiles
from fernglass.sources import tables
from fernglass.sources.tables import PIXELS_SQL

TOLERANCE, LEAST, FLOOR = 40, 3, 1


def color_match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tiles.match_counts(tables.tiles(spark, sf_dir), tables.palette(spark), TOLERANCE)
    return counts.select("image_id", F.col("color_id").cast("long").alias("color_id"), "matches").orderBy("image_id", "color_id")


MASK = f"{PIXELS_SQL}, mask AS (SELECT image_id, id::BIGINT AS color_id, y, x, r, g, b FROM pixels, palette WHERE a >= 128 AND (r-pr)*(r-pr) + (g-pg)*(g-pg) + (b-pb)*(b-pb) < {TOLERANCE * TOLERANCE})"
COLOR_MATCH_COUNT = f"WITH {MASK} SELECT image_id, color_id, count(*)::BIGINT AS matches FROM mask GROUP BY ALL ORDER BY ALL"


def mean_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.mean_colours(tables.tiles(spark, sf_dir))


MEAN_COLOR = f"WITH {PIXELS_SQL} SELECT image_id, count(*)::BIGINT AS n, floor(avg(r)+0.5)::BIGINT AS cr, floor(avg(g)+0.5)::BIGINT AS cg, floor(avg(b)+0.5)::BIGINT AS cb FROM pixels GROUP BY image_id"


def pixel_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tiles.measures(tables.tiles(spark, sf_dir), (128, 128, 128))
    return found.withColumns({c: F.round(c, 6) for c in ("distance", "brightness", "saturation", "luminance")})


PIXEL_MEASURES = f"""
WITH {PIXELS_SQL}, m AS (
  SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo, (r + g + b) / 3.0::DOUBLE AS br, greatest(abs(r-g), abs(g-b), abs(r-b)) AS sp,
    CASE WHEN greatest(r, g, b) = 0 THEN 0.0::DOUBLE ELSE (greatest(r, g, b) - least(r, g, b))::DOUBLE / greatest(r, g, b) END AS sat FROM pixels
), t AS (SELECT *, (b > g AND g > r AND r BETWEEN 100 AND 125 AND g BETWEEN 130 AND 150 AND b BETWEEN 165 AND 185 AND sat < 0.35) AS bg FROM m)
SELECT image_id, y, x, round(sqrt(((r-128)*(r-128) + (g-128)*(g-128) + (b-128)*(b-128))::DOUBLE), 6) AS distance, round(br::DOUBLE, 6) AS brightness, round(sat, 6) AS saturation, sp::BIGINT AS spread,
  round(0.299::DOUBLE*r + 0.587::DOUBLE*g + 0.114::DOUBLE*b, 6) AS luminance, (br > 30 AND br < 240 AND sp > 10 AND NOT bg) AS coloured, bg AS blue_gray, (br > 20 AND br < 240) AS inked,
  (hi - lo < 15 AND hi > 50 AND hi < 220) AS grayish, ((r > 240 AND g > 240 AND b > 240) OR (r < 15 AND g < 15 AND b < 15)) AS extreme
FROM t
"""


def highlight_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tiles.pixels(tiles.highlighted(tables.tiles(spark, sf_dir), (128, 128, 128), TOLERANCE))
    return rows.groupBy("image_id", "y").agg(F.count_if(F.col("a") == 140).alias("painted"), F.sum(F.col("r").cast("long")).alias("red"), F.sum(F.col("b").cast("long")).alias("blue"))


HIGHLIGHT_OVERLAY = f"WITH {PIXELS_SQL}, h AS (SELECT image_id, y, (a >= 128 AND (r-128)*(r-128)+(g-128)*(g-128)+(b-128)*(b-128) < 1600) AS hit FROM pixels) SELECT image_id, y, count(*) FILTER (hit)::BIGINT AS painted, (255 * count(*) FILTER (hit))::BIGINT AS red, 0::BIGINT AS blue FROM h GROUP BY ALL"


def row_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.row_shares(tables.tiles(spark, sf_dir)).withColumn("density", F.round("density", 6))


ROW_DENSITY = f"WITH {PIXELS_SQL} SELECT image_id, y, round(count(*) FILTER ((r+g+b)/3.0 > 20 AND (r+g+b)/3.0 < 240) / count(*)::DOUBLE, 6) AS density FROM pixels GROUP BY ALL"
BAND = (0.25, 2, 3)


def _red_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.row_shares(tables.tiles(spark, sf_dir), lambda planes: planes[0] > 145)


def row_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.row_bands(_red_density(spark, sf_dir), *BAND).select("image_id", F.col("y_start").cast("long").alias("y_start"), F.col("y_end").cast("long").alias("y_end"))


ROW_BANDS = f"""
WITH {PIXELS_SQL}, d AS (SELECT image_id, y, count(*) FILTER (r > 145) / count(*)::DOUBLE AS density FROM pixels GROUP BY ALL
), k AS (SELECT *, max(y) OVER (PARTITION BY image_id) AS last FROM d
), i AS (SELECT *, y - row_number() OVER (PARTITION BY image_id ORDER BY y) AS g FROM k WHERE density >= {BAND[0]}
), b AS (SELECT image_id, min(y) AS y_start, least(max(y) + 1, max(last)) AS y_end FROM i GROUP BY image_id, g HAVING least(max(y) + 1, max(last)) - min(y) >= {BAND[1]}
), f AS (SELECT *, coalesce((y_start - lag(y_end) OVER (PARTITION BY image_id ORDER BY y_start) >= {BAND[2]})::INT, 1) AS fresh FROM b
), s AS (SELECT *, sum(fresh) OVER (PARTITION BY image_id ORDER BY y_start) AS band FROM f)
SELECT image_id, min(y_start)::BIGINT AS y_start, max(y_end)::BIGINT AS y_end FROM s GROUP BY image_id, band
"""


def band_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.colours_of_bands(row_bands(spark, sf_dir), tiles.swatch_sums(tables.tiles(spark, sf_dir)))


BAND_COLOURS = f"""
WITH bands AS ({ROW_BANDS.strip()}), {PIXELS_SQL}
SELECT image_id, y_start, y_end, CASE WHEN count(*) >= 5 THEN floor(avg(r)+0.5)::BIGINT END AS cr, CASE WHEN count(*) >= 5 THEN floor(avg(g)+0.5)::BIGINT END AS cg, CASE WHEN count(*) >= 5 THEN floor(avg(b)+0.5)::BIGINT END AS cb
FROM bands JOIN pixels USING (image_id) WHERE y BETWEEN y_start AND y_end AND x < floor(64 * 0.35) AND (r+g+b)/3.0 <= 225 AND (r+g+b)/3.0 >= 30 GROUP BY ALL
"""
_COLUMNS = ("image_id", "color_id", "blob_id", "size", "cr", "cg", "cb", "min_x", "max_x", "min_y", "max_y")


def _shown(blobs: DataFrame, *more: str) -> DataFrame:
    return blobs.select(*(F.col(c).cast("long").alias(c) for c in _COLUMNS), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), *more)


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(tiles.regions(tables.tiles(spark, sf_dir), tables.palette(spark), TOLERANCE, LEAST))


REGIONS = f"""
{MASK}, g AS (SELECT *, x - row_number() OVER (PARTITION BY image_id, color_id, y ORDER BY x) AS g0 FROM mask
), runs AS (
  SELECT image_id, color_id, y, min(x) AS x0, max(x) AS x1, y * 16777216 + min(x) AS id, count(*) AS n, sum(x) AS sx, sum(r) AS sr, sum(g) AS sg, sum(b) AS sb FROM g GROUP BY image_id, color_id, y, g0
), e AS (
  SELECT a.image_id, a.color_id, a.id AS a, b.id AS b FROM runs a JOIN runs b ON a.image_id = b.image_id AND a.color_id = b.color_id AND abs(a.y - b.y) = 1 AND b.x0 <= a.x1 + 1 AND b.x1 >= a.x0 - 1
), reach AS (
  SELECT image_id, color_id, id, id AS root FROM runs UNION SELECT reach.image_id, reach.color_id, e.b, reach.root FROM reach JOIN e ON reach.image_id = e.image_id AND reach.color_id = e.color_id AND reach.id = e.a
), roots AS (SELECT image_id, color_id, id, min(root) AS root FROM reach GROUP BY ALL
), blobs AS (
  SELECT image_id, color_id, root::BIGINT AS blob_id, sum(n)::BIGINT AS size, floor(sum(sr)/sum(n)+0.5)::BIGINT AS cr, floor(sum(sg)/sum(n)+0.5)::BIGINT AS cg, floor(sum(sb)/sum(n)+0.5)::BIGINT AS cb,
    min(x0)::BIGINT AS min_x, max(x1)::BIGINT AS max_x, min(y)::BIGINT AS min_y, max(y)::BIGINT AS max_y, sum(sx)/sum(n)::DOUBLE AS x, sum(y * n)/sum(n)::DOUBLE AS y
  FROM runs JOIN roots USING (image_id, color_id, id) GROUP BY image_id, color_id, root HAVING sum(n) >= {LEAST}
)"""
BLOBS = f"WITH RECURSIVE {REGIONS} SELECT * REPLACE (round(x, 6) AS x, round(y, 6) AS y) FROM blobs"
NEAR = f"""
{REGIONS}, s AS (SELECT *, greatest({FLOOR}, 0.5 * greatest(max_x - min_x, max_y - min_y)) AS radius FROM blobs
), near AS (
  SELECT a.image_id, a.color_id, a.blob_id AS a, b.blob_id AS b FROM s a JOIN s b ON a.image_id = b.image_id AND a.color_id = b.color_id AND a.blob_id <> b.blob_id
    AND a.min_x - greatest(a.radius, b.radius) <= b.max_x AND a.max_x + greatest(a.radius, b.radius) >= b.min_x AND a.min_y - greatest(a.radius, b.radius) <= b.max_y AND a.max_y + greatest(a.radius, b.radius) >= b.min_y
), reach2 AS (
  SELECT image_id, color_id, blob_id AS id, blob_id AS root FROM blobs UNION SELECT reach2.image_id, reach2.color_id, near.b, reach2.root FROM reach2 JOIN near ON reach2.image_id = near.image_id AND reach2.color_id = near.color_id AND reach2.id = near.a
), roots2 AS (SELECT image_id, color_id, id AS blob_id, min(root) AS root FROM reach2 GROUP BY ALL
), merged AS (
  SELECT image_id, color_id, root::BIGINT AS blob_id, sum(size)::BIGINT AS size, floor(sum(cr*size)/sum(size)+0.5)::BIGINT AS cr, floor(sum(cg*size)/sum(size)+0.5)::BIGINT AS cg, floor(sum(cb*size)/sum(size)+0.5)::BIGINT AS cb,
    min(min_x) AS min_x, max(max_x) AS max_x, min(min_y) AS min_y, max(max_y) AS max_y, sum(x*size)/sum(size) AS x, sum(y*size)/sum(size) AS y, count(*)::BIGINT AS parts
  FROM blobs JOIN roots2 USING (image_id, color_id, blob_id) GROUP BY image_id, color_id, root
)"""


def merged_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tiles.regions(tables.tiles(spark, sf_dir), tables.palette(spark), TOLERANCE, LEAST)
    return _shown(raster.merged(found, FLOOR), "parts")


MERGED_BLOBS = f"WITH RECURSIVE {NEAR} SELECT * REPLACE (round(x, 6) AS x, round(y, 6) AS y) FROM merged"


def scan_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(tiles.scan(tables.tiles(spark, sf_dir), tables.palette(spark), TOLERANCE, LEAST, FLOOR), "parts", "pattern_score")


SCAN_PALETTE = f"WITH RECURSIVE {NEAR} SELECT * REPLACE (round(x, 6) AS x, round(y, 6) AS y), 1.0::DOUBLE AS pattern_score FROM merged WHERE greatest(max_x - min_x, max_y - min_y) / greatest(1, least(max_x - min_x, max_y - min_y))::DOUBLE < 8"


def found_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every palette colour, with one that no image shows."""
    palette = tables.palette(spark).unionByName(spark.createDataFrame([(4, "magenta", 255, 0, 255)], "id int, name string, r int, g int, b int"))
    found = tiles.regions(tables.tiles(spark, sf_dir), palette, TOLERANCE, LEAST)
    return state.hits_per_colour(palette, found).select(F.col("id").cast("long").alias("id"), "name", "hits", "part")


FOUND_PARTITION = f"WITH RECURSIVE {REGIONS}, p AS (SELECT id, name FROM palette UNION ALL SELECT 4, 'magenta'), h AS (SELECT color_id, count(*) AS n FROM blobs GROUP BY 1) SELECT id::BIGINT AS id, name, coalesce(n, 0)::BIGINT AS hits, CASE WHEN coalesce(n, 0) > 0 THEN 'found' ELSE 'missing' END AS part FROM p LEFT JOIN h ON id = color_id"


def _by_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of all colours; each (image, colour) counts as an image of its own."""
    found = tiles.regions(tables.tiles(spark, sf_dir), tables.palette(spark), TOLERANCE, LEAST)
    return found.withColumn("image_id", F.col("image_id") * 10 + F.col("color_id"))


_BY_COLOUR = f"{REGIONS}, o AS (SELECT * REPLACE (image_id * 10 + color_id AS image_id), row_number() OVER (PARTITION BY image_id, color_id ORDER BY floor(min_y / 30), min_x, min_y, blob_id) - 1 AS idx FROM blobs)"


def swatch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs in reading order."""
    return swatches.ordered(_by_colour(spark, sf_dir)).select("image_id", "blob_id", F.col("idx").cast("long").alias("idx"))


SWATCH_ORDER = f"WITH RECURSIVE {_BY_COLOUR} SELECT image_id, blob_id, idx::BIGINT AS idx FROM o"


def greedy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swatches.merge_near(swatches.ordered(_by_colour(spark, sf_dir)))


# One step looks at one later item j for the item i that grows; a row whose j is past the end has the finished i.
GREEDY_MERGE = f"""
WITH RECURSIVE {_BY_COLOUR}, l AS (
  SELECT image_id, count(*) AS n, list({{'size': size, 'cr': cr, 'cg': cg, 'cb': cb, 'min_x': min_x, 'max_x': max_x, 'min_y': min_y, 'max_y': max_y}} ORDER BY idx) AS s FROM o GROUP BY 1
), st AS (
  SELECT image_id, n, s, 0::BIGINT AS i, 1::BIGINT AS j, []::BIGINT[] AS used, s[1].size AS size, s[1].min_x AS min_x, s[1].max_x AS max_x, s[1].min_y AS min_y, s[1].max_y AS max_y FROM l
  UNION ALL
  SELECT image_id, n, s, CASE WHEN j < n THEN i ELSE nx END, CASE WHEN j < n THEN j ELSE nx END + 1, CASE WHEN ok THEN list_append(used, j) ELSE used END,
    CASE WHEN j >= n THEN s[nx + 1].size WHEN ok THEN size + b.size ELSE size END, CASE WHEN j >= n THEN s[nx + 1].min_x WHEN ok THEN least(min_x, b.min_x) ELSE min_x END, CASE WHEN j >= n THEN s[nx + 1].max_x WHEN ok THEN greatest(max_x, b.max_x) ELSE max_x END,
    CASE WHEN j >= n THEN s[nx + 1].min_y WHEN ok THEN least(min_y, b.min_y) ELSE min_y END, CASE WHEN j >= n THEN s[nx + 1].max_y WHEN ok THEN greatest(max_y, b.max_y) ELSE max_y END
  FROM (
    SELECT *, j < n AND NOT list_contains(used, j) AND (a.cr - b.cr) * (a.cr - b.cr) + (a.cg - b.cg) * (a.cg - b.cg) + (a.cb - b.cb) * (a.cb - b.cb) <= 2500
      AND min_x - 10 <= b.max_x AND max_x + 10 >= b.min_x AND min_y - 10 <= b.max_y AND max_y + 10 >= b.min_y AS ok
    FROM (SELECT *, s[i + 1] AS a, s[j + 1] AS b, CASE WHEN j >= n THEN list_filter(range(i + 1, n), lambda x: NOT list_contains(used, x))[1] END AS nx FROM st)
  ) WHERE j < n OR nx IS NOT NULL
)
SELECT image_id, i AS idx, size::BIGINT AS size, s[i + 1].cr AS cr, s[i + 1].cg AS cg, s[i + 1].cb AS cb, min_x, max_x, min_y, max_y FROM st WHERE j = n
"""


def swatch_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = swatches.ordered(_by_colour(spark, sf_dir))
    bounded = layout.right_boundaries(found, found.select("image_id").distinct().withColumn("width", F.lit(tables.SIDE)))
    return bounded.select("image_id", "blob_id", F.col("ord").cast("long").alias("ord"), F.round(F.col("right_boundary").cast("double"), 6).alias("right_boundary"))


SWATCH_BOUNDARIES = f"""
WITH RECURSIVE {_BY_COLOUR}, s AS (SELECT *, (row_number() OVER (PARTITION BY image_id ORDER BY floor(min_y / 25), min_x, idx) - 1)::BIGINT AS ord, (min_y + max_y) / 2.0::DOUBLE AS mid FROM o
), n AS (SELECT a.image_id, a.ord, arg_min(b.min_x, b.ord) AS beside FROM s a JOIN s b ON a.image_id = b.image_id AND b.ord > a.ord AND abs(b.mid - a.mid) < (a.max_y - a.min_y) * 1.2 AND b.min_x > a.max_x GROUP BY ALL)
SELECT image_id, blob_id, ord, round(least(max_x + 64 * 0.15::DOUBLE, coalesce(beside - 5, max_x + 64 * 0.15::DOUBLE))::DOUBLE, 6) AS right_boundary FROM s LEFT JOIN n USING (image_id, ord)
"""


def sampled_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point_id"), (F.col("p_partkey") % 10).alias("image_id"), (F.col("p_size") % 40).cast("long").alias("px"), (F.col("p_partkey") % 31).alias("py"))
    return tiles.sampled_colour(tables.tiles(spark, sf_dir), points, side=tables.SIDE)


SAMPLED_COLOUR = f"""
WITH {PIXELS_SQL}, points AS (SELECT p_partkey AS point_id, p_partkey % 10 AS image_id, p_size % 40 AS px, p_partkey % 31 AS py FROM part
), w AS (SELECT point_id, r, g, b, (x = px AND y = py) AS own, ((r > 240 AND g > 240 AND b > 240) OR (r < 15 AND g < 15 AND b < 15)) AS ex FROM points JOIN pixels USING (image_id)
  WHERE x BETWEEN greatest(0, px - 3) AND greatest(0, px - 3) + 6 AND y BETWEEN greatest(0, py - 3) AND greatest(0, py - 3) + 6)
SELECT point_id, coalesce(floor(avg(r) FILTER (NOT ex) + 0.5), max(r) FILTER (own))::BIGINT AS cr, coalesce(floor(avg(g) FILTER (NOT ex) + 0.5), max(g) FILTER (own))::BIGINT AS cg, coalesce(floor(avg(b) FILTER (NOT ex) + 0.5), max(b) FILTER (own))::BIGINT AS cb FROM w GROUP BY 1
"""


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    following = Window.partitionBy("label").orderBy("vec_id")
    return e.withColumn("w", F.lead("v").over(following)).withColumn("other", F.lead("vec_id").over(following)).where("w is not null")


def ncc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).select("vec_id", "other", F.round(templates.ncc(F.col("v"), F.col("w")), 6).alias("score"))


_PAIRS_SQL = "n AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS w, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS other FROM embeddings), c AS (SELECT vec_id, other, label, (SELECT corr(t.a, t.b) FROM (SELECT unnest(v) AS a, unnest(w) AS b) t) AS score FROM n WHERE w IS NOT NULL)"
NCC_PAIRS = f"WITH {_PAIRS_SQL} SELECT vec_id, other, round(score, 6) AS score FROM c"


def ncc_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best neighbours of each label, a top-k report."""
    best = Window.partitionBy("label").orderBy(F.col("score").desc(), "vec_id")
    rows = _neighbours(spark, sf_dir).select("label", "vec_id", F.round(templates.ncc(F.col("v"), F.col("w")), 6).alias("score"))
    return rows.withColumn("place", F.row_number().over(best).cast("long")).where("place <= 3").select(F.col("label").cast("long").alias("label"), "vec_id", "score", "place")


NCC_TOPK = f"WITH {_PAIRS_SQL}, r AS (SELECT label::BIGINT AS label, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY label ORDER BY round(score, 6) DESC, vec_id)::BIGINT AS place FROM c) SELECT * FROM r WHERE place <= 3"


def pattern_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ncc_pairs(spark, sf_dir).where(F.col("score") >= 0.05)


PATTERN_FILTER = f"WITH {_PAIRS_SQL} SELECT vec_id, other, round(score, 6) AS score FROM c WHERE round(score, 6) >= 0.05"


def centred_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 8 x 8 templates, the neighbour's cut to its first 48 values as 8 x 6: the middle 8 x 6 of one against the other."""
    s = lambda n: F.lit(n)
    return _neighbours(spark, sf_dir).select("vec_id", F.round(templates.overlap_ncc(F.col("v"), s(8), s(8), F.slice("w", 1, 48), s(8), s(6)), 6).alias("score"))


CENTRED_OVERLAP = "WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM embeddings) SELECT vec_id, round((SELECT corr(t.a, t.b) FROM (SELECT unnest(v[9:56]) AS a, unnest(w[1:48]) AS b) t), 6) AS score FROM n WHERE w IS NOT NULL"


SIDE, PATTERN = 9, 0.2


def template_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search of every colour with the template captured around the middle of its largest region."""
    images, palette = tables.tiles(spark, sf_dir), tables.palette(spark)
    found = tiles.regions(images, palette, TOLERANCE, LEAST)
    largest = found.groupBy("color_id").agg(F.max(F.struct("size", (-F.col("image_id")).alias("i"), (-F.col("blob_id")).alias("b"), "image_id", "x", "y")).alias("m"))
    points = largest.select("color_id", "m.image_id", F.col("m.x").alias("px"), F.col("m.y").alias("py"))
    captured = tiles.captured(images, templates.capture_boxes(points, tiles.image_sizes(images), SIDE), "color_id", tables.SIDE)
    return _shown(tiles.scan(images, palette, TOLERANCE, LEAST, FLOOR, captured, PATTERN, tables.SIDE), F.round("pattern_score", 6).alias("pattern_score"))


_LIGHT = "(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)::FLOAT::DOUBLE"
TEMPLATE_SCAN = f"""
WITH RECURSIVE {NEAR}, sz AS (SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height FROM pixels GROUP BY 1
), pick AS (SELECT color_id, image_id, floor(x)::BIGINT AS px, floor(y)::BIGINT AS py FROM (SELECT *, row_number() OVER (PARTITION BY color_id ORDER BY size DESC, image_id, blob_id) AS n FROM blobs) WHERE n = 1
), box AS (SELECT color_id, image_id, greatest(0, px - {SIDE // 2}) AS x0, greatest(0, py - {SIDE // 2}) AS y0, least(width, greatest(0, px - {SIDE // 2}) + {SIDE}) AS x1, least(height, greatest(0, py - {SIDE // 2}) + {SIDE}) AS y1 FROM pick JOIN sz USING (image_id)
), tp AS (SELECT color_id, x - x0 AS dx, y - y0 AS dy, {_LIGHT} AS v FROM box JOIN pixels USING (image_id) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1
), w0 AS (
  SELECT image_id, color_id, blob_id, box.x1 - box.x0 AS tw, box.y1 - box.y0 AS th, width, height, greatest(0, floor(x + 0.5)::BIGINT - (box.x1 - box.x0) // 2) AS wx, greatest(0, floor(y + 0.5)::BIGINT - (box.y1 - box.y0) // 2) AS wy
  FROM (SELECT * FROM merged WHERE greatest(max_x - min_x, max_y - min_y) / greatest(1, least(max_x - min_x, max_y - min_y))::DOUBLE < 8) JOIN (SELECT color_id, x0, y0, x1, y1 FROM box) AS box USING (color_id) JOIN sz USING (image_id)
), w AS (SELECT *, least(width, wx + tw) - wx AS rw, least(height, wy + th) - wy AS rh FROM w0
), cut AS (SELECT *, least(tw, rw) AS ww, least(th, rh) AS hh FROM w WHERE rw >= 0.7 * tw AND rh >= 0.7 * th
), pr AS (
  SELECT cut.image_id, cut.color_id, cut.blob_id, tp.v AS va, {_LIGHT} AS vb FROM cut JOIN tp ON tp.color_id = cut.color_id AND dx >= (tw - ww) // 2 AND dx < (tw - ww) // 2 + ww AND dy >= (th - hh) // 2 AND dy < (th - hh) // 2 + hh
    JOIN pixels ON pixels.image_id = cut.image_id AND pixels.x = wx + (rw - ww) // 2 + dx - (tw - ww) // 2 AND pixels.y = wy + (rh - hh) // 2 + dy - (th - hh) // 2
), sc AS (SELECT image_id, color_id, blob_id, covar_pop(va, vb) * count(*) AS over, sqrt(var_pop(va) * count(*) * var_pop(vb) * count(*)) AS under FROM pr GROUP BY ALL
), f AS (
  SELECT image_id, color_id, blob_id, CASE WHEN NOT (rw >= 0.7 * tw AND rh >= 0.7 * th) THEN 0.5::DOUBLE WHEN rw = tw AND rh = th THEN CASE WHEN under < 1e-4 THEN 0.0::DOUBLE ELSE over / under END
    WHEN least(tw, rw) * least(th, rh) < 16 OR under < 1e-4 THEN 0.5::DOUBLE ELSE over / under END AS score FROM w LEFT JOIN sc USING (image_id, color_id, blob_id)
)
SELECT m.* EXCLUDE (parts) REPLACE (round(x, 6) AS x, round(y, 6) AS y), round(score, 6) AS pattern_score FROM merged m JOIN f USING (image_id, color_id, blob_id) WHERE score >= {PATTERN}
"""


def swatch_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as regions of many sizes, fills and colours: those of a swatch's shape."""
    p = tables.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("w"), (F.col("p_partkey") % 40 + 5).alias("h"))
    rows = p.select(F.lit(1).alias("image_id"), F.col("p_partkey").alias("blob_id"), F.lit(0).alias("min_x"), F.col("w").alias("max_x"), F.lit(0).alias("min_y"), F.col("h").alias("max_y"), F.floor(F.col("w") * F.col("h") * (F.col("p_partkey") % 11) / 10).alias("size"),
        (F.col("w") * 5 % 256).alias("cr"), (F.col("p_partkey") % 256).alias("cg"), (F.col("p_partkey") * 7 % 256).alias("cb"))
    sizes = spark.createDataFrame([(1, 300, 250)], "image_id int, width int, height int")
    return swatches.shaped(rows, sizes).select("blob_id", F.col("max_x").cast("long").alias("w"), F.col("max_y").cast("long").alias("h"), "size")


SWATCH_SHAPES = """
WITH p AS (SELECT p_partkey AS blob_id, p_size::BIGINT AS w, p_partkey % 40 + 5 AS h, p_size * 5 % 256 AS r, p_partkey % 256 AS g, p_partkey * 7 % 256 AS b FROM part
), q AS (SELECT *, floor(w * h * (blob_id % 11) / 10)::BIGINT AS size, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM p)
SELECT blob_id, w, h, size FROM q WHERE w >= 12 AND h >= 12 AND NOT (w > 250 * 0.12::DOUBLE AND h > 250 * 0.12::DOUBLE) AND size >= 80 AND greatest(w, h)::DOUBLE / least(w, h) <= 4 AND size::DOUBLE / (w * h) >= 0.35::DOUBLE
  AND NOT (hi - lo < 15 AND hi > 50 AND hi < 220) AND NOT (b > g AND g > r AND r BETWEEN 100 AND 125 AND g BETWEEN 130 AND 150 AND b BETWEEN 165 AND 185 AND (hi - lo)::DOUBLE / hi < 0.35)
"""


def legend_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names as words on the rasters, read row band by row band."""
    k = F.col("p_partkey")
    words = tables.table(spark, sf_dir, "part").select((k % 10).alias("image_id"), k.cast("int").alias("word_idx"), F.col("p_name").alias("text"), F.col("p_size").cast("double").alias("confidence"), (k * 7 % 64).cast("int").alias("x0"), (k % 60).cast("int").alias("y0"), (k * 7 % 64 + 9).cast("int").alias("x1"), (k % 60 + 4).cast("int").alias("y1"))
    return legend.row_entries(tiles.row_sums(tables.tiles(spark, sf_dir)), row_bands(spark, sf_dir), words).where(F.char_length("name") >= 2)


LEGEND_ROWS = f"""
WITH c AS ({BAND_COLOURS}), w AS (SELECT p_partkey % 10 AS image_id, p_partkey AS word_idx, p_name, p_size, p_partkey * 7 % 64 AS x0, p_partkey % 60 + 2 AS mid FROM part WHERE p_partkey * 7 % 64 >= 16
), j AS (SELECT c.image_id, y_start, y_end, cr, cg, cb, string_agg(p_name, ' ' ORDER BY x0, word_idx) AS raw, floor(avg(p_size) + 0.5)::BIGINT AS confidence FROM c JOIN w ON c.image_id = w.image_id AND mid BETWEEN y_start AND y_end WHERE cr IS NOT NULL GROUP BY ALL
), n AS (SELECT *, {rules.sql_clean("trim(raw)")} AS name FROM j)
SELECT image_id, y_start, y_end, cr, cg, cb, name, confidence, y_start AS ord FROM n WHERE length(name) >= 2
"""


def area_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = F.pow("p_size", F.lit(3)).cast("long")
    rows = tables.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("image_id"), area.alias("area"))
    return swatches.size_fence(rows)


AREA_FENCE = "WITH p AS (SELECT p_partkey, p_brand AS image_id, (p_size::BIGINT * p_size * p_size)::BIGINT AS area FROM part), q AS (SELECT image_id, list_sort(list(area)) AS s, count(*) AS n FROM p GROUP BY 1) SELECT p.* FROM p JOIN q USING (image_id) WHERE n < 5 OR (area >= 0.05 * s[floor(n * 0.25)::INT + 1] AND area <= 20 * s[floor(n * 0.75)::INT + 1])"



def _digests(spark: SparkSession, sf_dir: str, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Size and sum of the gray values of boxes' templates."""
    key = F.concat_ws(",", *keys).alias("key_")
    found = tiles.captured(tables.tiles(spark, sf_dir), boxes.select(key, "image_id", "x0", "y0", "x1", "y1"), "key_", tables.SIDE)
    total = F.round(F.aggregate("gray", F.lit(0.0), lambda s, v: s + v), 3).alias("total")
    return found.select(*(F.split("key_", ",")[i].cast("long").alias(k) for i, k in enumerate(keys)), "width", "height", total)


def swatch_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates cut out of merged regions that are large enough."""
    found = raster.merged(tiles.regions(tables.tiles(spark, sf_dir), tables.palette(spark), TOLERANCE, LEAST), FLOOR)
    return _digests(spark, sf_dir, templates.swatch_boxes(found), ["image_id", "color_id", "blob_id"])


_CUT = f"SELECT {{keys}}, (max(x1) - max(x0))::BIGINT AS width, (max(y1) - max(y0))::BIGINT AS height, round(sum({_LIGHT}), 3) AS total FROM boxes JOIN pixels USING (image_id) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY {{keys}}"
SWATCH_TEMPLATES = f"WITH RECURSIVE {NEAR}, boxes AS (SELECT image_id, color_id, blob_id, min_x AS x0, max_x AS x1, min_y AS y0, max_y AS y1 FROM merged WHERE max_x - min_x >= 8 AND max_y - min_y >= 8) {_CUT.format(keys='image_id, color_id, blob_id')}"


def row_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of row bands: squares in the middle of the left quarter."""
    boxes = templates.row_boxes(row_bands(spark, sf_dir), tiles.image_sizes(tables.tiles(spark, sf_dir)))
    return _digests(spark, sf_dir, boxes, ["image_id", "y_start", "y_end"])


ROW_TEMPLATES = f"""
WITH bands AS ({ROW_BANDS.strip()}), {PIXELS_SQL}, sz AS (SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height FROM pixels GROUP BY 1
), q AS (SELECT *, least(32, y_end - y_start, floor(width * 0.25)::BIGINT) AS side, floor(floor(width * 0.25) / 2)::BIGINT AS cx, floor((y_start + y_end) / 2)::BIGINT AS cy FROM bands JOIN sz USING (image_id)
), c AS (SELECT *, greatest(0, cx - side // 2) AS x0, greatest(0, cy - side // 2) AS y0 FROM q WHERE side >= 8
), boxes AS (SELECT image_id, y_start, y_end, x0, y0, least(width, x0 + side) AS x1, least(height, y0 + side) AS y1 FROM c WHERE least(width, x0 + side) - x0 >= 8 AND least(height, y0 + side) - y0 >= 8
) {_CUT.format(keys='image_id, y_start, y_end')}
"""


def drawn(spark: SparkSession, sf_dir: str, gray: bool = False) -> DataFrame:
    """Tiles of a legend for each brand: a box for each of its parts, four in a row, on white; every fifth is cut in two by a white line. With `gray`, all boxes of
    brands whose number is divisible by 7 are gray, so that they are no swatches."""
    plain = (F.substring("p_brand", 7, 9).cast("int") % 7 == 0) if gray else F.lit(False)
    p = tables.table(spark, sf_dir, "part").withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("p_brand")))
    key, wide = F.col("p_partkey"), F.when(F.col("p_partkey") % 5 == 0, 28).otherwise(12) + F.col("p_size") % 5
    boxes = p.select(F.col("p_brand").alias("image_id"), (F.floor((F.col("n") - 1) / 4) * 30 + 30).cast("int").alias("height"), (F.col("k") % 4 * 60 + 8).cast("int").alias("x"), (F.floor(F.col("k") / 4) * 30 + 8).cast("int").alias("y"), wide.cast("int").alias("w"), (key % 7 + 9).cast("int").alias("h"),
        (key % 5 == 0).alias("halved"), *(F.when(plain, 128).otherwise(v % 256).cast("int").alias(c) for c, v in (("r", F.col("p_size") * 5), ("g", key), ("b", key * 7))))
    boxes = boxes.withColumn("strip", F.explode(F.sequence(F.floor(F.col("y") / tables.SIDE), F.floor((F.col("y") + F.col("h")) / tables.SIDE))))

    def paint(batches):
        from itertools import groupby

        import numpy as np
        import pyarrow as pa

        made: list[tuple] = []

        def batch():
            parts = [tiles.batch_of(pa.scalar(image, pa.string()), rows) for image, rows in made]
            made.clear()
            return pa.Table.from_batches(parts).combine_chunks().to_batches()

        rows = (row for found in batches for row in zip(*(c.to_pylist() for c in found.columns), strict=True))
        for (image, strip, height), here in groupby(rows, lambda row: row[:3]):
            top = strip * tables.SIDE
            planes = np.full((4, min(tables.SIDE, height - top), 248), 255, np.uint8)
            for *_, x, y, w, h, halved, r, g, b in here:
                part = planes[:, max(0, y - top) : max(0, y + h + 1 - top)]
                part[:3, :, x : x + w + 1] = np.array((r, g, b), np.uint8)[:, None, None]
                if halved:
                    part[:, :, x + 13 : x + 16] = 255
            made.append((image, list(tiles.cut(planes, tables.SIDE, top, height))))
            if len(made) == 32:
                yield from batch()
        if made:
            yield from batch()

    # Few bytes of boxes make many of planes, so their strips are dealt to a fixed number of tasks, which adaptive execution does not join. A task paints strip after strip.
    dealt = boxes.repartition(tables.dealt(spark), "image_id", "strip").sortWithinPartitions("image_id", "strip")
    return dealt.select("image_id", "strip", "height", "x", "y", "w", "h", "halved", "r", "g", "b").mapInArrow(paint, f"image_id string, {tiles.FIELDS}")


def swatches_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swatches found in drawn legends, from pixels to the fence of sizes."""
    return swatches.detect(drawn(spark, sf_dir))


# From the parts alone, without pixels: the pieces that the drawing consists of, those that pass the rules, halves joined, and the fence.
SWATCHES_DETECTED = """
WITH p AS (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part
), b AS (
  SELECT p_brand AS image_id, p_partkey, ((n - 1) // 4) * 30 + 30 AS height, k % 4 * 60 + 8 AS x, k // 4 * 30 + 8 AS y, CASE WHEN p_partkey % 5 = 0 THEN 28 ELSE 12 END + p_size % 5 AS w, p_partkey % 7 + 9 AS h,
    (p_size * 5 % 256)::BIGINT AS r, (p_partkey % 256)::BIGINT AS g, (p_partkey * 7 % 256)::BIGINT AS b FROM p
), c AS (
  SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo, (r + g + b) / 3.0::DOUBLE AS shade FROM b
), m AS (
  SELECT * FROM c WHERE shade > 30 AND shade < 240 AND hi - lo > 10 AND NOT (b > g AND g > r AND r BETWEEN 100 AND 125 AND g BETWEEN 130 AND 150 AND b BETWEEN 165 AND 185 AND (hi - lo)::DOUBLE / hi < 0.35) AND NOT (hi - lo < 15 AND hi > 50 AND hi < 220)
), pieces AS (
  SELECT *, x AS x0, CASE WHEN p_partkey % 5 = 0 THEN x + 12 ELSE x + w END AS x1 FROM m UNION ALL SELECT *, x + 16, x + w FROM m WHERE p_partkey % 5 = 0
), s AS (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y // 30, x0, y) - 1 AS idx FROM pieces
  WHERE x1 - x0 >= 12 AND h >= 12 AND NOT (x1 - x0 > least(248, height) * 0.12::DOUBLE AND h > least(248, height) * 0.12::DOUBLE) AND (x1 - x0 + 1) * (h + 1) >= 80
), j AS (
  SELECT image_id, min(idx) AS idx, sum((x1 - x0 + 1) * (h + 1)) AS size, max(r) AS cr, max(g) AS cg, max(b) AS cb, min(x0) AS min_x, max(x1) AS max_x, min(y) AS min_y, max(y + h) AS max_y FROM s GROUP BY image_id, p_partkey
), a AS (SELECT *, (max_x - min_x) * (max_y - min_y) AS area FROM j
), q AS (SELECT image_id, list_sort(list(area)) AS s, count(*) AS n FROM a GROUP BY 1)
SELECT image_id, idx::BIGINT AS idx, size::BIGINT AS size, cr, cg, cb, min_x::BIGINT AS min_x, max_x::BIGINT AS max_x, min_y::BIGINT AS min_y, max_y::BIGINT AS max_y
FROM a JOIN q USING (image_id) WHERE n < 5 OR (area >= 0.05 * s[floor(n * 0.25)::INT + 1] AND area <= 20 * s[floor(n * 0.75)::INT + 1])
"""

QUERIES = {f.__name__: f for f in (color_match_count, mean_color, pixel_measures, highlight_overlay, row_density, row_bands, band_colours, blobs, merged_blobs, scan_palette, found_partition, swatch_order, greedy_merge, swatch_boundaries, sampled_colour, ncc_pairs, ncc_topk, pattern_filter, centred_overlap, template_scan, swatch_shapes, legend_rows, area_fence, swatch_templates, row_templates, swatches_detected)}
ORACLES = {n.lower(): globals()[n] for n in ("COLOR_MATCH_COUNT", "MEAN_COLOR", "PIXEL_MEASURES", "HIGHLIGHT_OVERLAY", "ROW_DENSITY", "ROW_BANDS", "BAND_COLOURS", "BLOBS", "MERGED_BLOBS", "SCAN_PALETTE", "FOUND_PARTITION", "SWATCH_ORDER", "GREEDY_MERGE", "SWATCH_BOUNDARIES", "SAMPLED_COLOUR", "NCC_PAIRS", "NCC_TOPK", "PATTERN_FILTER", "CENTRED_OVERLAP", "TEMPLATE_SCAN", "SWATCH_SHAPES", "LEGEND_ROWS", "AREA_FENCE", "SWATCH_TEMPLATES", "ROW_TEMPLATES", "SWATCHES_DETECTED")}
