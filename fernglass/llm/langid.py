"""Language identification by a linear-chain conditional random field over words.

A word is the letters of a part between white space. Its features are its prefixes and suffixes (up to 3 characters
and a boundary mark), its inner n-grams (2 and 3 characters) and, from a lexicon of frequent training words, the word itself. Each feature has a weight for each language, and
each pair of neighbouring languages a learned transition. A text is one chain, so that code-switched text
is labelled word by word: forward-backward gives each word's marginal probabilities. It goes block by block, `BLOCK` words at a time, side by side:
each block's transfer matrix carries what stands before and after a block across it, so a long text's marginals are those of
its whole chain. A text's score for a language is the mean of its words' marginals.

Training takes whole texts of at most `docs_per_lang` labelled rows of each language, chosen by hash, and of these at most `words` words,
as many of each language (both are documented bounds). It cuts them into short runs, mixes runs of all languages into chains of `BLOCK` words (that is
where transitions between languages are seen) and climbs the exact gradient of the log-likelihood. Prediction is one pass over the scan without any
shuffle; emission scores are cached by word.

Null texts and texts without letters get `und` and score 0. Rows with null lang are not learned from; with no labelled row at
all every text is `und`. Repeated rows give repeated results; ties go to the language that sorts first; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.llm._shared import claim, crc_mod, map_arrow, taken

BLOCK = 64
DOCS_PER_LANG, TRAIN_WORDS, RUN, EPOCHS, RATE, DECAY = 250, 160_000, 12, 40, 0.3, 1e-5
SEED = 11


def grams(word: str) -> list[str]:
    """Features of a lower-cased word but for the lexicon's: n-grams of 2 and 3 characters of the word between marks,
    and the 4 at either end."""
    w = f"<{word}>"
    return [*map("".join, zip(w, w[1:])), *map("".join, zip(w, w[1:], w[2:])), w[:4], w[-4:]]


def word_of(part: str) -> str:
    """The letters of a part between white space."""
    return part if part.isalpha() else "".join(filter(str.isalpha, part))


def words_of(text: str) -> list[str]:
    return [w for part in text.lower().split() if (w := word_of(part))]


def transfers(emit: np.ndarray, step: np.ndarray, live: np.ndarray) -> np.ndarray:
    """(blocks, labels, labels): weight of each label at a block's end after each label before the block, up to a factor for each block."""
    blocks, length, labels = emit.shape
    out = np.broadcast_to(np.eye(labels, dtype=emit.dtype), (blocks, labels, labels)).copy()
    for t in range(length):
        now = (out.reshape(-1, labels) @ step).reshape(out.shape) * emit[:, t, None]
        now /= now.max((1, 2), keepdims=True)
        out = np.where(live[:, t, None, None], now, out)
    return out


def carried(emit: np.ndarray, step: np.ndarray, live: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What enters each block from the left and leaves it to the right, (blocks, labels) both, up to factors.

    counts: blocks of each text, which stand one after the other."""
    first = np.cumsum(counts) - counts
    enter, leave = np.ones((len(emit), emit.shape[2]), emit.dtype), np.ones((len(emit), emit.shape[2]), emit.dtype)
    follows = np.ones(len(emit), bool)
    follows[first] = False
    if not follows.any():
        return enter, leave
    across = np.empty((len(emit), emit.shape[2], emit.shape[2]), emit.dtype)
    across[follows] = transfers(emit[follows], step, live[follows])
    long = np.flatnonzero(counts > 1)
    now = emit[first[long], 0]
    for t in range(1, emit.shape[1]):  # the first of several blocks is full
        now = (now @ step) * emit[first[long], t]
        now /= now.sum(1, keepdims=True)
    for b in range(1, int(counts.max())):
        some = counts[long] > b
        long, now = long[some], now[some]
        at = first[long] + b
        enter[at] = now @ step
        now = np.einsum("ij,ijk->ik", now, across[at])
        now /= now.sum(1, keepdims=True)
    for b in range(int(counts.max()) - 1, 0, -1):
        at = first[counts > b] + b
        before = np.einsum("ijk,ik->ij", across[at], leave[at])
        leave[at - 1] = before / before.max(1, keepdims=True)
    return enter, leave


def forward_backward(emit: np.ndarray, step: np.ndarray, live: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (chains, length, labels), expected transitions (labels, labels) and log-likelihood normalizers by chain.

    emit: exp of emission scores (chains, length, labels); step: exp of transition scores; live: (chains, length) true for
    words, which come first in each chain; enter and leave: what stands before and after a chain, if it is a block of one."""
    chains, length, labels = emit.shape
    alpha, scale = np.empty_like(emit), np.ones((chains, length), emit.dtype)
    now = emit[:, 0] if enter is None else emit[:, 0] * enter
    for t in range(length):
        if t:
            now = (alpha[:, t - 1] @ step) * emit[:, t]
            now = np.where(live[:, t, None], now, alpha[:, t - 1])
        total = now.sum(1)
        scale[:, t] = np.where(live[:, t], total, 1)
        alpha[:, t] = now / total[:, None]
    beta = np.ones((chains, labels), emit.dtype) if leave is None else leave
    marginal, moves = np.empty_like(emit), np.zeros((labels, labels))
    marginal[:, -1] = alpha[:, -1] * beta
    for t in range(length - 1, 0, -1):
        inner = emit[:, t] * beta
        some = live[:, t, None]
        weight = np.where(some, inner / scale[:, t, None], 0)
        moves += (alpha[:, t - 1].T @ weight) * step
        beta = np.where(some, weight @ step.T, beta)
        marginal[:, t - 1] = alpha[:, t - 1] * beta
    marginal /= marginal.sum(2, keepdims=True)
    return marginal, moves, np.log(scale).sum(1)


class Crf:
    """Languages, feature numbers, weights (features, languages) and transition scores."""

    def __init__(self, langs: list[str], features: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.langs, self.features, self.weights, self.steps = langs, features, weights.astype(np.float32), steps
        self.key = uuid.uuid4().hex

    def emissions(self, words: list[str]) -> np.ndarray:
        """exp of the emission scores of lower-cased words, the largest of each word 1."""
        get = self.features.get
        found = [[i for g in (*grams(w), f"={w}") if (i := get(g)) is not None] for w in words]
        out = np.zeros((len(words), len(self.langs)), np.float32)
        sizes = np.array([len(f) for f in found])
        if sizes.any():
            has = np.flatnonzero(sizes)
            flat = np.fromiter((i for f in found for i in f), np.int64, sizes.sum())
            out[has] = np.add.reduceat(self.weights[flat], np.cumsum(sizes[has]) - sizes[has], axis=0)
        out -= out.max(1, keepdims=True)
        return np.exp(out)


def train(texts: list[tuple[str, str]], epochs: int = EPOCHS, words: int = TRAIN_WORDS, seed: int = SEED) -> Crf | None:
    """A field from (text, language) rows; None without any word. Runs on the driver over a bounded sample."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for _, lang in texts})
    runs = []
    for text, lang in texts:
        found = words_of(text)
        runs += [(langs.index(lang), found[i : i + RUN]) for i in range(0, len(found), RUN)]
    if not runs:
        return None
    share = words // len(langs)
    order, held, chosen = rng.permutation(len(runs)), Counter(), []
    for i in order:
        if held[runs[i][0]] < share:
            chosen.append(runs[i])
            held[runs[i][0]] += len(runs[i][1])
    types: dict[str, int] = {}
    ids = np.fromiter((types.setdefault(w, len(types)) for _, r in chosen for w in r), np.int64)
    labels = np.repeat([a for a, _ in chosen], [len(r) for _, r in chosen])
    counts = np.bincount(ids)
    names = list(types)
    seen = Counter(g for w in names for g in set(grams(w)))
    kept = [g for g, n in seen.items() if n >= 3] + [f"={w}" for w, n in zip(names, counts, strict=True) if n >= 3]
    crf = Crf(langs, {g: i for i, g in enumerate(sorted(kept))}, np.zeros((len(kept), len(langs))), np.zeros((len(langs),) * 2))
    get = crf.features.get
    found = [[i for g in (*grams(w), f"={w}") if (i := get(g)) is not None] for w in names]
    flat, owner = np.fromiter((i for f in found for i in f), np.int64), np.repeat(np.arange(len(names)), [len(f) for f in found])
    n, k = len(ids), len(langs)
    rows = -(-n // BLOCK)
    place = np.full(rows * BLOCK, -1)
    place[:n] = np.arange(n)
    live = (place >= 0).reshape(rows, BLOCK)
    before = np.flatnonzero(np.arange(1, n) % BLOCK)  # places whose next word is in the same chain
    true_moves = np.zeros((k, k))
    np.add.at(true_moves, (labels[before], labels[before + 1]), 1)
    truth = np.zeros((len(names), k))
    np.add.at(truth, (ids, labels), 1)
    weights, steps = np.zeros((len(kept), k)), np.zeros((k, k))
    speed_w, speed_s = np.full(weights.shape, 1e-8), np.full(steps.shape, 1e-8)
    for _ in range(epochs):
        score = np.stack([np.bincount(owner, weights[flat, c], len(names)) for c in range(k)], 1)
        emit = np.ones((rows * BLOCK, k))
        emit[:n] = np.exp(score - score.max(1, keepdims=True))[ids]
        marginal, moves, _ = forward_backward(np.maximum(emit, 1e-30).reshape(rows, BLOCK, k), np.exp(steps), live)
        guess = marginal.reshape(-1, k)[:n]
        miss = truth - np.stack([np.bincount(ids, guess[:, c], len(names)) for c in range(k)], 1)
        grad = np.stack([np.bincount(flat, miss[owner, c], len(kept)) for c in range(k)], 1) / n - DECAY * weights
        grad_s = (true_moves - moves) / n - DECAY * steps
        speed_w += grad**2
        speed_s += grad_s**2
        weights += RATE * grad / np.sqrt(speed_w)
        steps += RATE * grad_s / np.sqrt(speed_s)
    return Crf(langs, crf.features, weights, steps)


class Labeller:
    """Posterior of texts under a field. Numbers of words are cached by part, and emissions by word; 0 is no word."""

    def __init__(self, crf: Crf, limit: int = 400_000):
        self.crf, self.limit = crf, limit
        self.step = np.exp(crf.steps).astype(np.float32)
        self._empty()

    def _empty(self) -> None:
        self.parts: dict[str, int] = {}
        self.known: dict[str, int] = {"": 0}
        self.emit = np.ones((1, len(self.crf.langs)), np.float32)

    def ids(self, parts: list[str]) -> np.ndarray:
        """Numbers of the words of parts, valid until the next call."""
        found = list(map(self.parts.get, parts))
        if None in found:
            if len(self.parts) > self.limit:
                self._empty()
                found = [None] * len(parts)
            new = {p: word_of(p) for p, i in zip(parts, found, strict=True) if i is None}
            words = list({w for w in new.values() if w not in self.known})
            for at in range(0, len(words), 20_000):
                some = words[at : at + 20_000]
                self.known.update(zip(some, range(len(self.emit), len(self.emit) + len(some)), strict=True))
                self.emit = np.concatenate([self.emit, self.crf.emissions(some)])
            self.parts.update((p, self.known[w]) for p, w in new.items())
            found = map(self.parts.__getitem__, parts)
        return np.fromiter(found, np.int64, len(parts))

    def marginals(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, (words, languages) marginals by forward-backward over its chain."""
        cut = [t.lower().split() for t in texts]
        ids = self.ids([p for some in cut for p in some])
        owner = np.repeat(np.arange(len(texts)), [len(c) for c in cut])[ids > 0]
        ids = ids[ids > 0]
        sizes = np.bincount(owner, minlength=len(texts))
        chains = -(-sizes // BLOCK)
        first = np.cumsum(chains) - chains
        rows, k = int(chains.sum()), len(self.crf.langs)
        at = np.repeat(first * BLOCK - np.cumsum(sizes) + sizes, sizes) + np.arange(len(ids))
        emit, live = np.ones((rows * BLOCK, k), np.float32), np.zeros(rows * BLOCK, bool)
        emit[at] = np.maximum(self.emit[ids], 1e-12)
        live[at] = True
        emit, live = emit.reshape(rows, BLOCK, k), live.reshape(rows, BLOCK)
        marginal = forward_backward(emit, self.step, live, *carried(emit, self.step, live, chains[chains > 0]))[0].reshape(-1, k)[at]
        return np.split(marginal, np.cumsum(sizes)[:-1]) if texts else []

    def languages(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        for m in self.marginals([t or "" for t in texts]):
            mean = m.mean(0, dtype=np.float64) if len(m) else None
            out.append(("und", 0.0) if mean is None else (self.crf.langs[int(mean.argmax())], min(1.0, float(mean.max()))))
        return out


_held: dict[str, Labeller] = {}


def _labeller(crf: Crf) -> Labeller:
    claim("languages", _held.clear)
    if crf.key not in _held:
        _held.clear()
        _held[crf.key] = Labeller(crf)
    return _held[crf.key]


def sample(df: DataFrame, text: str, lang: str, doc_id: str, docs_per_lang: int) -> list[tuple[str, str]]:
    """Whole texts of about `docs_per_lang` rows of each language, at most that many, by hash of id and text; equal rows count once."""
    rows = df.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null and t is not null")
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    place = F.pmod(F.xxhash64(F.lit(SEED), "i", "t"), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.5 * docs_per_lang / n + 8 / n))))
    got = rows.where(place < share[F.col("l")]).select("t", "l", place.alias("p"), "i").distinct().collect()
    taken: Counter[str] = Counter()
    out = []
    for r in sorted(got, key=lambda r: (r.p, str(r.i), r.t)):
        taken[r.l] += 1
        if taken[r.l] <= docs_per_lang:
            out.append((r.t, r.l))
    return out


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(df: DataFrame, crf: Crf | None, text: str = "text", doc_id: str = "doc_id", folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, whether the row is held out (crc32 of its id modulo `folds` is `held`), the language and its score."""
    model = df.sparkSession.sparkContext.broadcast(crf)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start, stop, texts in taken(batch.column(2)):
            found = _labeller(model.value).languages(texts) if model.value else [("und", 0.0)] * (stop - start)
            part = batch.slice(start, stop - start)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return map_arrow(df.select(F.col(doc_id).cast("long").alias("i"), F.coalesce(crc_mod(doc_id, folds) == held, F.lit(False)).alias("h"), F.col(text).cast("string").alias("t")), run, SCHEMA)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(sample(docs.where(crc_mod("doc_id", 4) != 2), "text", "lang", "doc_id", DOCS_PER_LANG)))
