import json
import struct
import zlib

from pyspark.sql import functions as F

from fernglass.operators import media, state
from fernglass.sources import images
from fernglass.sources.store import Store, autosave_key, restored
from fernglass.streaming import ingest


def test_store(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", "id long, name string, saved_at timestamp", "id")
    assert store.version() == 0 and store.read().count() == 0
    rows = lambda *names: spark.createDataFrame([(n,) for n in names], "name string").withColumn("saved_at", F.lit(None).cast("timestamp"))
    store.insert(rows("a", "b"))
    store.insert(rows("c"))
    store.put(spark.createDataFrame([(2, "B", None), (9, "z", None)], store.schema))
    store.delete(spark.createDataFrame([(1,)], "id long"))
    assert sorted((r.id, r.name) for r in store.read().collect()) == [(2, "B"), (3, "c"), (9, "z")] and store.version() == 4
    assert store.get(3).first().name == "c"
    wider = Store(spark, f"{tmp_path}/s", "id long, name string, saved_at timestamp, more string", "id")
    assert {r.more for r in wider.read().collect()} == {None}


def test_store_leaves_untouched_buckets_alone(spark, tmp_path):
    files = lambda: {str(p.relative_to(tmp_path)) for p in (tmp_path / "s" / "data").rglob("part-*")}
    store = Store(spark, f"{tmp_path}/s", "id long, name string", "id", 16)
    store.put(spark.range(400).select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name")))
    before = files()
    assert len(before) == 16 and store.get(7).first().name == "n7" and len(store.get(7).inputFiles()) == 1
    store.put(spark.createDataFrame([(7, "new"), (7, "new")], store.schema))
    after = files()
    assert before <= after and len(after - before) == 1  # the bucket's old file stays for readers of the last version
    store.delete(spark.createDataFrame([(7,)], "id long"))
    assert len(files() - after) == 1 and len(before & files()) == 15 and store.read().count() == 399
    store.insert(spark.createDataFrame([("late",)], "name string"))
    assert len(before & files()) == 15 and store.get(400).first().name == "late" and store.read().count() == 400
    store.delete(store.read())
    assert store.read().count() == 0 and store.get(1).count() == 0
    store.insert(spark.createDataFrame([("again",)], "name string"))
    assert [tuple(r) for r in store.read().collect()] == [(1, "again")]
    # Later changes keep the store's own number of buckets, whatever is asked for.
    other = Store(spark, f"{tmp_path}/s", "id long, name string", "id", 3)
    other.put(spark.range(1, 50).select("id", F.lit("x").alias("name")))
    assert store.read().count() == 49 and {store.get(i).first().name for i in (1, 25, 49)} == {"x"}


def test_restored(spark, tmp_path):
    key = autosave_key("plan_v", 3, "x.png")
    store = Store(spark, f"{tmp_path}/s", "key string, palette array<string>", "key")
    legacy = spark.createDataFrame([(key, '{"palette": ["red"]}'), ("bad", "{")], "key string, body string")
    assert restored(store, key, legacy).first().palette == ["red"]
    store.put(spark.createDataFrame([(key, ["blue"])], store.schema))
    assert restored(store, key, legacy).first().palette == ["blue"]


def test_export(spark):
    row = spark.range(1).select(state.export_json(F.lit("f"), F.lit(40), F.lit("d"), F.array(F.struct(F.lit(1).alias("id"), F.lit("n").alias("name"), F.lit("c").alias("color"), F.lit(None).cast("int").alias("count"))), F.array(), F.struct(F.lit(2).alias("markers"), F.lit(0).alias("feedback")), F.struct(F.lit(3).alias("wrong"))).alias("j")).first()
    assert json.loads(row.j)["legendEntries"] == [{"id": 1, "name": "n", "color": "c", "count": 0}] and "\n" in row.j


def test_photos(spark):
    urls = ["a/flower1", "b/x", "a/flower1", "c/Bloom", "d/close", "e/detail"]
    df = spark.createDataFrame([("p", i, u) for i, u in enumerate(urls)] + [("q", i, f"full{i}") for i in range(3)] + [("r", 0, "only/one")], "search_name string, ord int, url string")
    got = {r.search_name: (r.closeup, r.full) for r in media.photos(df).collect()}
    assert got == {"p": (["a/flower1", "c/Bloom", "d/close"], ["b/x"]), "q": (["full2"], ["full0", "full1"]), "r": ([], ["only/one"])}
    titles = spark.createDataFrame([("maple.jpg",), ("rose.jpg",), ("A Logo",)], "t string")
    assert [r.k for r in titles.select(media.is_photo(F.col("t")).alias("k")).collect()] == [False, True, False]
    one = spark.createDataFrame([('{"thumbnail": {"source": "u/220px-a/330px-b"}, "originalimage": {"source": "o"}}',), ("bad",)], "body string")
    assert [r.urls for r in media.summary_urls(one).collect()] == [["u/800px-a/330px-b", "o"], []]


def test_image_files(spark, tmp_path):
    raw = b"".join(b"\0" + bytes(v for x in range(3) for v in (10 * x, y, 200)) for y in range(2))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    (tmp_path / "p.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    (tmp_path / "junk.txt").write_bytes(b"no image")
    px = images.pixels(images.images(spark, str(tmp_path)))
    assert sorted((r.y, r.x, r.r, r.g, r.b, r.a) for r in px.collect()) == [(y, x, 10 * x, y, 200, 255) for y in range(2) for x in range(3)]
    assert sorted((r.y, r.x, r.r) for r in images.cropped(px, 1, 1, 2, 1).collect()) == [(0, 0, 10), (0, 1, 20)]
    assert images.thumbnails(px, 1).count() == 1
    files = spark.createDataFrame([("A.PDF", None), ("a.png", "application/pdf"), ("a.png", None)], "path string, mime string")
    assert [r.p for r in files.select(images.is_pdf(F.col("path"), F.col("mime")).alias("p")).collect()] == [True, True, False]


def test_stream_into_store(spark, tmp_path):
    schema = "marker_id string, ts timestamp, rating string"
    for i, rows in enumerate(([("a", 1, "close"), ("b", 1, "wrong")], [("a", 2, "correct")])):
        spark.createDataFrame([(m, None, r) for m, _, r in rows], schema).withColumn("ts", F.lit(f"2024-01-0{i + 1}").cast("timestamp")).write.parquet(f"{tmp_path}/in/{i}")
    store = Store(spark, f"{tmp_path}/s", schema, "marker_id")
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        ingest.upsert_into(stream, store, "ts", f"{tmp_path}/c").awaitTermination()
    assert sorted((r.marker_id, r.rating) for r in store.read().collect()) == [("a", "correct"), ("b", "wrong")]
    counts = ingest.windowed_counts(spark.createDataFrame([("a", "2024-01-01", "close")], "m string, ts string, rating string").withColumn("ts", F.col("ts").cast("timestamp")))
    assert counts.first().n == 1


def test_export_has_all_feedback(spark):
    from fernglass.plans import records

    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("event_id", "user_id", "ts", "event_type").collect()
    kinds = {"view": "correct", "click": "close", "error": "wrong", "signup": "duplicate"}
    latest = {}
    for e in sorted(events, key=lambda e: (e.ts, e.event_id)):
        latest[str(e.user_id)] = kinds.get(e.event_type)
    rows = records.export_json(spark, "/root/testdata/sf0.01").collect()
    got = [json.loads(r.json) for r in rows if r.part == "feedback"]
    assert len(got) == len(latest) > 20 and {f["marker_id"]: f.get("rating") for f in got} == latest
    (head,) = [json.loads(r.json) for r in rows if r.part == "head"]
    assert head["feedbackCount"] == len(latest) and "feedback" not in head
    assert head["summary"]["correct"] == sum(e.event_type == "view" for e in events)


def test_export_document_is_one_json_text(spark):
    from fernglass.plans import records

    rows = records.export_document(spark, "/root/testdata/sf0.001").collect()
    got = json.loads("".join(r.line for r in sorted(rows, key=lambda r: (r.part, r.marker_id or ""))))
    assert [*got] == ["exportDate", "imageFilename", "colorTolerance", "legendEntries", "totalMarkers", "feedbackCount", "feedback", "summary"]
    assert len(got["feedback"]) == got["feedbackCount"] > 5 and all(tuple(f) == state.FEEDBACK_FIELDS for f in got["feedback"])
    none = state.export_lines(spark.createDataFrame([("f", 40, "d", [], 0, 0, (1,))], "filename string, tolerance int, date string, legend array<struct<id:int,name:string,color:string,count:int>>, markers int, feedback_count int, summary struct<correct:int>"), spark.createDataFrame([], "markerId string, timestamp string, rating string, detectedName string, detectedColor array<int>, position struct<x:int,y:int>, correctName string, notes string, isMissing boolean"))
    assert json.loads("".join(r.line for r in none.orderBy("part").collect()))["feedback"] == []


def test_columns_may_have_any_names(spark):
    """Helper columns of lookups, upserts and edits don't meet the tables' own."""
    odd = [("k_", 1), ("n_", 2), ("l_", 3), ("hit_", 4), ("p_name", 5), ("n_common", 6)]
    rows = spark.createDataFrame([(i, "Ab", *(v for _, v in odd)) for i in (1, 2, 2)], "id int, name string, " + ", ".join(f"{c} int" for c, _ in odd))
    dim = spark.createDataFrame([("ab", 5), ("AB", 3)], "kind string, ord int")
    assert {r.ord for r in state.left_lookup(rows, dim, "name", "kind", "ord", fold=True).collect()} == {3}
    assert state.left_lookup(rows, dim, "name", "kind", "ord", fold=True).columns == [*rows.columns, "kind", "ord"]
    assert state.latest(rows, "id", "n_", "k_").columns == rows.columns and state.latest(rows, "id", "n_", "k_").count() == 2
    assert state.unlisted(rows, rows.limit(0)).count() == 3 and state.without(rows, rows.where("id = 1"), "id").count() == 2
