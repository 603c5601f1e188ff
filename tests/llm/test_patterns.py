"""Packing by patterns: placements against a plain replay, sequences against the least number, ids against the tokenizer, odd rows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fernglass.llm import packing, patterns

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def replay(placements, counts, capacity):
    """Sequences as lists of (offset, length); each rank of a length is placed once."""
    seen, out = defaultdict(set), defaultdict(list)
    for length, first, n, seq, each, offset in placements:
        for r in range(n):
            assert first + r not in seen[length]
            seen[length].add(first + r)
            out[seq + r // each].append((offset + r % each * length, length))
    assert all(seen[n] == set(range(c)) for n, c in enumerate(counts.tolist()))
    for parts in out.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 40), st.data())
def test_every_rank_has_one_place(capacity, data):
    counts = np.array([0, *data.draw(st.lists(st.integers(0, 30), min_size=capacity, max_size=capacity))])
    placements, n = patterns.placed(counts, capacity)
    assert set(replay(placements, counts, capacity)) == set(range(n))


def test_few_patterns_by_stride_still_place_all():
    rng = np.random.default_rng(1)
    counts = np.concatenate([[0], rng.integers(0, 50, 256)])
    assert len(patterns.exact_patterns(counts, 256, 500)) < 1000 < len(patterns.exact_patterns(counts, 256))
    placements, n = patterns.placed(counts, 256, 500)
    assert set(replay(placements, counts, 256)) == set(range(n))


def test_patterns_fill_exactly_and_are_all_there_are():
    counts = np.ones(21, int)
    counts[[0, 7]] = 0
    got = patterns.exact_patterns(counts, 20)
    want = {(20,)} | {(a, 20 - a) for a in range(10, 20)} | {(a, b, 20 - a - b) for a in range(1, 19) for b in range(1, a + 1) if 1 <= 20 - a - b <= b}
    assert set(got) == {p for p in want if 7 not in p} and len(got) == len(set(got))


def test_fit_is_a_least_squares_solution():
    """No step of one repeat count lowers the distance to the histogram."""
    rng = np.random.default_rng(2)
    counts = np.concatenate([[0], rng.integers(0, 400, 30)])
    found = patterns.exact_patterns(counts, 30)
    x = np.array(patterns.fitted(found, counts, 3000))
    a = np.zeros((31, len(found)))
    for k, p in enumerate(found):
        for n in p:
            a[n, k] += 1
    slope = a.T @ ((np.arange(31) / 30) ** 2 * (a @ x - counts))
    assert (x >= 0).all() and slope.min() > -3 and np.abs(slope[x > 1]).max() < 3


@pytest.mark.parametrize("shape", ["flat", "short", "long", "one"])
def test_near_the_least_number(shape):
    rng = np.random.default_rng(3)
    lengths = {"flat": rng.integers(1, 2049, 20_000), "short": rng.geometric(1 / 150, 40_000).clip(1, 2048), "long": rng.integers(900, 2049, 20_000), "one": np.full(9_000, 682)}[shape]
    counts = np.bincount(lengths, minlength=2049)
    placements, n = patterns.placed(counts, 2048)
    replay(placements, counts, 2048)
    # Lengths above a half never share a sequence.
    least = max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum()), 3_000 if shape == "one" else 0)
    assert least <= n <= 1.005 * least
    assert len(placements) < 3 * patterns.PATTERNS + 64 * 2 * 2048


SCHEMA = "doc_id long, text string, piece int, start long, length string, part int, rank long, ids string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1, 1, "x", 1, 1, "y") for i, t in rows], SCHEMA)


def checked(rows, packed, capacity=2048):
    """Pieces of each text are its ids in order, only long ones are cut, sequences are gapless; returns the sequences."""
    tokenizer = packing.Ids(TOKENIZER).tokenizer
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in packed:
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    want, got = [], []
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(str(i), k, at, len(part := ids[at : at + capacity]), zlib.crc32(part.tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
    for r in packed:
        got.append((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32))
        if "ids" in r.asDict():
            assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert sorted(got) == sorted(want)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_documents_round_trip(spark):
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "Straße", "x1", "…", "delta,"]
    rows = [(i, " ".join(r.choices(words, k=r.choice([1, 5, 90, 400, 900, 3000])))) for i in range(240)]
    rows += [(900, None), (901, ""), (902, " \n "), (None, "a null id"), (7, "again"), (7, "again"), (904, "word " * 9000)]
    packed = patterns.pack(documents(spark, rows).repartition(5), TOKENIZER).collect()
    sequences = checked(rows, packed)
    total = sum(n for parts in sequences.values() for _, n in parts)
    assert len(sequences) <= 1.1 * total / 2048  # over half of the texts take more than half a sequence
    assert patterns.pack(documents(spark, []), TOKENIZER).count() == 0


def test_whole_numbers_of_copies(spark):
    """A third of all rows have one length: they are ranked task by task."""
    rows = [(i, "the same words each time" if i % 3 else f"text {i} " * (i % 40)) for i in range(900)]
    checked(rows, patterns.pack(documents(spark, rows).repartition(7), TOKENIZER, ids=False).collect())


def test_query_over_the_tables(spark, sf_dir="/root/testdata/sf0.001"):
    packed = patterns.op12_patterns(spark, sf_dir).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    sequences = checked(rows, packed)
    total = sum(n for parts in sequences.values() for _, n in parts)
    assert len(sequences) <= -(-total // 2048) + 1
