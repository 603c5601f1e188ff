"""The operators over DataFrames: results against brute force, and nulls, empty and long texts, repeats, empty tables, clashing names."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fernglass.llm import audio, chat, decontaminate, jaccard, langid, packing, registry, resample, secrets, toxicity, urls
from fernglass.llm._graph import components

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, hub long, block int"


def table(spark, rows):
    """Documents with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), 1.0, 1, 1, 1) for i, t in rows], SCHEMA)


def odd_rows():
    return [(1, None), (2, ""), (3, " \n\t "), (4, "!!! 12 --"), (5, "word " * 30_000), (None, "a null id has a text too"), (7, "again and again and again"), (7, "again and again and again"), (8, "again and again and again")]


# edge cases


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, odd_rows())


def test_languages_of_odd_rows(spark, odd):
    crf = langid.train([("the cat is here", "en"), ("der hund ist da", "de")] * 3)
    got = langid.identify(odd, crf).collect()
    assert len(got) == 9 and [r.lang_pred for r in got if r.doc_id in (1, 2, 3, 4)] == ["und"] * 4
    assert all(0 <= r.score <= 1 for r in got) and len({(r.lang_pred, r.score) for r in got if r.doc_id in (7, 8)}) == 1
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id)
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.sample(odd, "text", "lang", "doc_id", 5) == [] and langid.identify(odd.limit(0), crf).count() == 0


def test_sample_is_bounded(spark):
    df = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.when(F.col("id") % 9 == 0, "aa").when(F.col("id") % 9 == 1, None).otherwise("bb").alias("lang"))
    got = langid.sample(df, "text", "lang", "doc_id", 50)
    assert sum(k == "aa" for _, k in got) == 50 and sum(k == "bb" for _, k in got) == 50


def test_packing_odd_rows(spark, odd):
    rows = packing.pack(odd, TOKENIZER).collect()
    tokenizer = packing.Ids(TOKENIZER).tokenizer
    for i, text in odd_rows():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == i)
        if i != 7:
            assert sum(p[1] for p in pieces) == len(ids)
        for start, length, crc, total in pieces:
            assert crc == zlib.crc32(ids[start : start + length].tobytes()) and total == len(ids)
    assert packing.pack(odd.limit(0), TOKENIZER).count() == 0


def test_packed_windows_hold_their_ids(spark, odd):
    rows = packing.pack(odd, TOKENIZER).collect()
    tokenizer = packing.Ids(TOKENIZER).tokenizer
    texts = dict(odd_rows())
    want = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    windows = defaultdict(bytes)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == len(windows[r.sequence_id]) // 4
        windows[r.sequence_id] += r.ids
        assert (np.frombuffer(r.ids, "<u4") == want[r.doc_id][r.start : r.start + r.length]).all() and len(r.ids) == 4 * r.length
    assert all(len(w) <= 4 * packing.CAPACITY for w in windows.values())
    assert sum(map(len, windows.values())) == 4 * sum(len(want[i]) for i, _ in odd_rows())


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (7, 1), (2, 0), (99, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    got = toxicity.detect(odd, model).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 for r in got) and {r.score for r in got if r.doc_id in (1, 2, 3, 4)} == {0.0}
    assert toxicity.keep_clean(odd, toxicity.Sentences({"again": 20.0})).count() == 6
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    assert toxicity.fit(odd.limit(0), labels.limit(0)).weights == {}


def test_urls(spark):
    cases = ["http://A.Example.com/en/x?y#z", "https://www.example.com/en/1", "ftp://x.net/fr/", "http://net/es/a", "http://x.net/de/", None, "no scheme", "", "http://", "http://h?x/y", "http://example.com", "http://notnet/es/", "x://WWW.EXAMPLE.COM/en/#://z", "http://ünï.com/ä"]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")).collect()}
    for i, url in enumerate(cases):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({a: a + 32 for a in range(65, 91)})
        fits = [(len(h + p), h + p, k) for k, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, max(fits)[1] if fits else None), url
        assert got[i].verdict == max(fits)[2] if fits else got[i].verdict in ("allow", "block")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string, host string, path string")).count() == 0


@pytest.mark.parametrize("limit", (3, 1000))
def test_models_count_all_ruled_urls(spark, limit):
    rng = random.Random(limit)
    good = [f"www.example.com/en/{rng.choice(('tea', 'sea', 'ünï'))}{i}" for i in range(40)]
    bad = [f"x{i}.net/fr/{rng.randrange(10**6)}" for i in range(40)]
    rest = [f"y.org/{rng.choice(('tea', 'fr', 'zz'))}/{i}" for i in range(20)]
    df = spark.createDataFrame([(i, f"http://{u}" if u else None) for i, u in enumerate([*good, *good[:5], *bad, *rest, None, None])], "page_id long, url string")
    by_hash = lambda some: [r.t for r in spark.createDataFrame([(t,) for t in some], "t string").orderBy(F.xxhash64(F.lit(urls.SEED), "t"), "t").limit(limit).collect()]
    half = urls.train(by_hash(good), by_hash(bad))
    want = urls.Ratio(urls.Markov(good), urls.Markov(bad), half.cut, half.slope)
    got = urls.judge(df, limit=limit).collect()
    assert len(got) == 107
    for r in got:
        assert r.block_score == pytest.approx(want.blocked(r.host + r.path), abs=1e-9)
        assert r.rule or r.verdict == ("block" if r.block_score > 0.5 else "allow")


def test_all_ruled_urls_calibrate(spark):
    rng = random.Random(11)
    good = [f"www.example.com/en/{rng.choice(('tea', 'sea', 'fr'))}{rng.randrange(10**5)}-{i}" for i in range(61)]
    bad = [f"x{i}.net/fr/{rng.choice(('tea', 'zz'))}{rng.randrange(10**6)}" for i in range(48)]
    df = spark.createDataFrame([(i, f"http://{u}") for i, u in enumerate([*good, *bad, *good[:3], "y.org/a"])], "page_id long, url string")
    by_hash = lambda some: [r.t for r in spark.createDataFrame([(t,) for t in some], "t string").orderBy(F.xxhash64(F.lit(urls.SEED), "t"), "t").collect()]
    want = urls.train(by_hash(good), by_hash(bad))
    got = urls.judge(df).collect()
    assert len(got) == 113
    for r in got:
        assert r.block_score == pytest.approx(want.blocked(r.host + r.path), abs=1e-9)


def test_no_url_is_fetched_to_calibrate(spark, monkeypatch):
    monkeypatch.setattr(urls, "sample", lambda *_: pytest.fail("a sample calibrates"))
    df = spark.createDataFrame([(i, f"http://{h}/{i}") for i, h in enumerate(("a.com", "b.com", "example.com/en", "x.net/fr", "y.org"))], "page_id long, url string")
    assert urls.judge(df).count() == 5


def test_leaks_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "again and again and again"), (2, None), (3, ""), (4, "!!"), (None, "a null id has a text too"), (6, "nothing of this kind stands in any of these")], "item_id long, text string")
    got = decontaminate.contaminated(odd, bench).collect()
    assert sorted((str(r.doc_id), str(r.item_id)) for r in got) == [("7", "1"), ("7", "1"), ("8", "1"), ("None", "None")] and {r.score for r in got} == {1.0}
    split = decontaminate.contaminated(odd, bench, limit=10).collect()  # a block for each item
    assert sorted(map(str, split)) == sorted(map(str, got))
    kept = decontaminate.without_leaks(odd, bench)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5]
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0 and decontaminate.contaminated(odd.limit(0), bench).count() == 0


def test_secrets_of_odd_rows(spark, odd):
    got = secrets.scan(odd).collect()
    assert len(got) == 9 and {r.spans for r in got} == {""} and {r.base_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
    df = table(spark, [(1, "é token = abcdefabcdefabcdefabcdefabcdef12"), (2, None)])
    one = secrets.scan(df).where("doc_id = 1").first()
    assert (one.n_assign, one.n_hex) == (1, 1) and one.spans == "assign:2:42,guess:10:42,hex:10:42".replace("guess:10:42,hex:10:42", "hex:10:42,guess:10:42")
    clean = {r.doc_id: r for r in secrets.redact(df).collect()}
    assert clean[1].text == "é token = [secret]" and clean[1].n_chars == 18 and clean[2].text is None and secrets.redact(df).columns == df.columns
    assert secrets.scan(odd.limit(0)).count() == 0


def test_audio_of_odd_rows(spark, odd):
    got = audio.text_audio(odd).collect()
    texts = defaultdict(list)
    for (i, text), r in zip(odd_rows(), sorted(got, key=lambda r: [k for k, _ in odd_rows()].index(r.doc_id)), strict=True):
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        texts[payload].append((r.media_sha256, r.feature))
    assert all(len(set(v)) == 1 for v in texts.values())
    media = spark.createDataFrame([(1, audio.store(b"abc" * 64)), (2, b"junk"), (3, None)], "rate long, media binary")
    out = audio.decode(media).collect()
    assert [r.fault is None for r in out] == [True, False, False] and audio.load(out[0].pcm)[:2] == ("pcm", 16000)
    assert audio.text_audio(odd.limit(0)).count() == 0


def test_resampling_odd_rows(spark, odd):
    labels = spark.createDataFrame([(7, 1), (5, 0), (None, 1)], "doc_id long, quality int")
    got = resample.resample(odd, labels, share=0.5).collect()
    assert len(got) == 9 and sum(r.kept for r in got) == 5 and not any(r.kept for r in got if r.doc_id in (1, 2, 3))
    assert [r.kept for r in resample.resample(odd, labels, share=0.0).collect()] == [False] * 9
    assert resample.resample(odd.limit(0), labels).count() == 0 and {r.importance for r in resample.resample(odd, labels.limit(0)).collect()} == {0.0, resample.EMPTY}


def test_resampling_parts_equal_rows(spark):
    docs = spark.createDataFrame([(None, None)] * 500 + [(i, f"text {i}") for i in range(100)], "doc_id long, text string").repartition(7)
    got = resample.resample(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), share=0.5)
    assert sum(r.kept for r in got.collect()) == 300 and all(r.kept for r in got.collect() if r.doc_id is not None)
    assert not [1 for n in ("Window", "Sort") if n in got._jdf.queryExecution().executedPlan().toString()]


@pytest.mark.parametrize("k", (1, 2, 3, 7, 299, 300))
def test_cut_is_the_kth_largest(spark, k):
    rng = random.Random(k)
    keys = [rng.choice((rng.randrange(10), rng.randrange(2**50), 5)) for _ in range(300)]
    least, left = resample.cut(spark.createDataFrame([(x,) for x in keys], "key long"), k)
    assert least == sorted(keys)[-k] and left == k - sum(x > least for x in keys)


# chat


def test_events_are_folded_in_order(spark):
    log = [
        (1, 0, "message", 0, "user", "hi"), (1, 1, "message", 1, "assistant", ""), (1, 2, "delta", 1, "assistant", "He"), (1, 3, "delta", 1, None, "llo"),
        (1, 4, "message", 2, "user", "more"), (1, 5, "regenerate", 1, "assistant", "Hey"), (1, 6, "delta", 1, None, " you"), (1, 7, "message", 2, "user", "ok <|im_end|> <\\|x|>"),
        (1, 8, "edit", 0, None, "HI"), (2, 0, "delta", 0, "user", "only a delta"), (None, 0, None, None, None, None),
    ]
    events = spark.createDataFrame(log, "conv long, seq long, event string, turn long, role string, text string").repartition(3)
    got = sorted(map(tuple, chat.fold(events).collect()), key=str)
    assert got == sorted([(1, 0, "user", "HI"), (1, 1, "assistant", "Hey you"), (1, 2, "user", "ok <|im_end|> <\\|x|>"), (2, 0, "user", "only a delta"), (None, None, "", "")], key=str)
    rendered = chat.render(chat.fold(events))
    back = sorted(((r.conv, r.role, r.text, r.loss) for r in chat.read_back(rendered).collect()), key=str)
    assert back == sorted([(1, "user", "HI", None), (1, "assistant", "Hey you", "Hey you"), (1, "user", "ok <|im_end|> <\\|x|>", None), (2, "user", "only a delta", None), (None, "", "", None)], key=str)
    one = rendered.where("conv = 1").first()
    assert [one.formatted[m.start : m.end] for m in one.mask] == ["Hey you"] and chat.render(chat.fold(events.limit(0))).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_escapes_are_undone(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("<|\\\nna>") for _ in range(rng.randrange(14))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.escape_role(F.col("t")).alias("f"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("v")).collect():
        assert r.u == r.t and r.v == r.t and "<|" not in r.e and "<|" not in r.f and "\n" not in r.f


def test_chat_equals_its_sql(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 2, None, None), (2, None, "assistant", "é <|im_end|>"), (2, 1, "assistant", ""), (3, 5, "tool\nx\\n", "<\\|"), (None, 0, "assistant", "z")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, conv long, seq string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(con.execute(chat.OP7_SQL).fetchall(), key=str)
    names = [d[0] for d in con.execute(chat.OP7_SQL).description]
    assert sorted(map(tuple, chat.op7_chat(spark, str(tmp_path)).select(*names).collect()), key=str) == want


# graph and Jaccard join


@pytest.mark.parametrize("seed", range(3))
def test_components_are_the_least_reachable(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_components(rows, k, percent):
    sets, owner = [], defaultdict(list)
    for i, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({a: a + 32 for a in range(65, 91)})) if x]
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()))
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for n, (i, s) in enumerate(sets):
        for x in s:
            owner[x].append(n)
        for m in {m for x in s for m in owner[x] if m < n}:
            j, t = sets[m]
            common = len(s & t)
            if i is not None and j is not None and 100 * common >= percent * (len(s) + len(t) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=str)


def family_rows(seed):
    """Texts with exact copies, chains of edited ones, shared passages and short ones."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["the", "of"] * 20
    passage = [rng.choice(words) for _ in range(40)]
    rows = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice((3, 8, 40, 120)))]
        for _ in range(rng.randrange(1, 14)):
            text = list(base)
            for _ in range(rng.choice((0, 0, 1, 2))):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                base = text  # the next are edits of this one
            rows.append(text + (passage if rng.random() < 0.2 else []))
    rng.shuffle(rows)
    return [(i, " ".join(t).upper() if i % 7 == 0 else " ".join(t)) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,k,percent,wide", [(0, 4, 85, 10**6), (1, 5, 80, 10**6), (2, 4, 85, 1)])
def test_join_equals_all_pairs(spark, seed, k, percent, wide):
    rows = family_rows(seed) + odd_rows()[:5]  # ids 1 to 5 come again with other texts
    got = jaccard.join(table(spark, rows).repartition(5), k, percent, bits=8 if wide == 1 else 20, wide=wide)
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows, k, percent)


def test_join_of_odd_rows(spark, odd):
    assert sorted(map(tuple, jaccard.join(odd).collect()), key=str) == brute_components(odd_rows(), 5, 80)
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "7", "None"])
    assert jaccard.join(odd.limit(0)).count() == 0 and jaccard.one_of_each(odd.limit(0)).count() == 0


# pipeline


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = [f"wo{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    text = lambda n: ". ".join(" ".join(rng.choice(vocabulary) for _ in range(9)) for _ in range(n))
    rows = [(i, text(8)) for i in range(120)]
    rows += [(i, text(3) + ". you vilethings here. " + text(3)) for i in range(120, 180)]
    rows += [(200, rows[3][1]), (201, rows[4][1] + " end"), (202, "token = 9f8A7b6C5d4E3f2G1h " + text(4)), (203, None), (204, "")]
    leak = text(4).replace(".", "")
    rows.append((205, text(2) + " " + leak + " " + text(2)))
    docs = table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(120 <= i < 180)) for i in range(0, 180) if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        seen.append({r.doc_id for r in kept.collect()})
    toxic, near, leaks, scanned = seen
    assert {i for i, _ in rows} - toxic == set(range(120, 180))
    assert toxic - near == {200, 201} and near - leaks == {205} and scanned == leaks
    assert kept.where("doc_id = 202").first().text.startswith("token = [secret] ")
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == scanned


def test_stages_take_odd_rows(spark, tmp_path):
    rows = [*odd_rows(), (9, "nine has one text of its own here"), (9, "and another text under the same number nine"), (10, "and another text under the same number nine")]
    docs = table(spark, rows).withColumn("__gone", F.lit(1)).withColumn("key", F.lit(2))
    spark.createDataFrame([(1, 1, 0), (9, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for some, want in ((docs, ["1", "2", "3", "4", "5", "7", "9", "9", "None"]), (docs.limit(0), [])):
        kept = some
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, str(tmp_path))
            assert kept.columns == docs.columns, name
        assert sorted(str(r.doc_id) for r in kept.collect()) == want
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path))
        assert sorted({str(r.doc_id) for r in packed.collect()}) == sorted(set(want))


def test_unlike_texts_under_one_id_all_stay(spark):
    rows = [(1, "one two three four five six seven"), (1, "quite another text than the first one is"), (2, "one two three four five six seven"), (1, None), (1, None)]
    kept = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(table(spark, rows)).collect()), key=str)
    assert kept == sorted([rows[0], rows[1], rows[3], rows[4]], key=str)


def test_near_copies_below_the_limit_make_few_pairs(spark, monkeypatch):
    """500 edited copies of one text, most of them not linked: their links are found without comparing all of them."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(140)]
    rows = []
    for i in range(500):
        text = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 4, 6, 9, 12))):
            text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}" if rng.random() < 0.9 else "same"
        if i % 10 == 3 and rows:  # a copy of a copy, one word off
            text = rows[-1][1].split()
            text[5] = f"z{i}"
        rows.append((i, " ".join(text)))
    made, tables = [], jaccard.materialize

    def counted(df, label):
        out = tables(df, label)
        if label in ("places", "pairs", "near"):
            made.append((label, out.count()))
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    got = sorted(map(tuple, jaccard.join(table(spark, rows), 4, 85).collect()), key=str)
    want = brute_components(rows, 4, 85)
    assert got == want
    assert len({c for _, _, c in want}) > 100  # many are linked with nothing
    assert sum(n for _, n in made) < 20_000  # all pairs would be 124,750


def family_rows(m):
    """Four families of m near copies: 110 rare words that all share, 180 of the family that 5 m other documents hold too, and a few of their own."""
    rng, rows = random.Random(m), []
    rare = [f"rare{i}" for i in range(110)]
    for f in range(4):
        own = [f"family{f}word{i}" for i in range(180)]
        for k in range(m):
            rows.append((len(rows), " ".join([*rare, *own, *(f"x{len(rows)}y{i}" for i in range(rng.choice((2, 6, 12))))])))
    for f in range(4):
        own = [f"family{f}word{i}" for i in range(180)]
        for k in range(5 * m):
            rows.append((len(rows), " ".join([*own, *(f"z{len(rows)}y{i}" for i in range(200))])))
    return rows


def test_families_in_one_group_make_pairs_in_proportion(spark, monkeypatch):
    """Rows of pairs inside groups grow with the families' size, not with its square, and links are those of all pairs."""
    tables, made = jaccard.materialize, []

    def counted(df, label):
        out = tables(df, label)
        if label == "near":
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    sums = []
    for m in (30, 90):
        made.clear()
        got = {r.doc_id: r.component_id for r in jaccard.join(table(spark, family_rows(m)), 1, 80).collect()}
        assert got == {i: i // m * m if i < 4 * m else i for i in range(24 * m)}
        sums.append(sum(made))
    assert sums[1] <= 40 * 90 and sums[1] <= 4 * max(sums[0], 30), sums


def test_broken_media_have_a_fault(spark):
    whole = audio.text_media(table(spark, [(1, "good"), (2, None)]))
    junk = spark.createDataFrame([(3, 4, None), (4, 4, bytearray(b"junk")), (5, 4, bytearray(b"RIFF    WAVEfmt ")), (6, 4, bytearray(b""))], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in audio.described(whole.unionByName(junk)).collect()}
    assert got[1].fault is None and got[1].payload_bytes == 192 and got[2].payload_bytes == 192 and got[1].feature
    assert all(got[i].fault and got[i].feature is None and got[i].payload_sha256 is None for i in (3, 4, 5, 6))
    assert audio.described(junk.limit(0)).count() == 0 and {r.doc_id for r in audio.described(junk).collect()} == {3, 4, 5, 6}


def test_queries_are_registered():
    assert [re.match(r"op(\d+)_", n)[1] for n in registry.QUERIES] == [str(i) for i in range(1, 14)]
