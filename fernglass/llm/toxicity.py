"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels.

A sentence's probability is the logistic of a low base plus the weights of its words; a word's weight is the sum of those of
the word and of its beginnings of 4 to 7 characters. A document's probability is 1 - (1 - leak) * product(1 - sentence),
where the leak takes up labels that no sentence explains. Weights are not negative, and chosen among features that
labelled documents show more often when toxic. The likelihood of the document labels is
climbed over a bounded sample of whole labelled texts (near copies vote once), and the weights then locate the
offending sentences. A document's reported score leaves the leak out: it speaks of what stands in the text.

Scoring is one pass over the scan without any shuffle. Null and empty texts score 0; rows without labels are not learned
from; with labels of one kind only all scores are 0; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.llm._shared import claim, crc_mod, map_arrow

PARTS = re.compile(r"\w+|[.!?\n]+")
ENDS = re.compile(r"[.!?\n]+")
SAMPLE, BASE, LIMIT, STEPS, RATE, SPARE = 5000, -10.0, 3000, 250, 0.1, 0.02
THRESHOLD, SEED = 0.7, 5


def features(word: str) -> list[str]:
    """The word, and its proper beginnings of 4 to 7 characters, marked by a star."""
    return [word, *(word[:n] + "*" for n in range(4, min(8, len(word))))]


class _Words(dict):
    """Weight of each word by the weights of its features; None where that is 0. Emptied when it is full."""

    def __init__(self, weights: dict[str, float], limit: int = 200_000):
        super().__init__()
        self.weights, self.limit = weights, limit

    def __missing__(self, word: str) -> float | None:
        if len(self) >= self.limit:
            self.clear()
        total = 0.0 if word[0] in ".!?\n" else sum(self.weights.get(f, 0.0) for f in features(word)) or None
        self[word] = total
        return total


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Sentences:
    """Feature weights and the base; scores texts and locates sentences."""

    def __init__(self, weights: dict[str, float], base: float = BASE):
        self.weights, self.base, self._words = weights, base, _Words(weights)

    def __reduce__(self):
        return Sentences, (self.weights, self.base)

    def scores(self, text: str) -> np.ndarray:
        """A probability for each sentence that has a word with a weight."""
        sums, total = [], 0.0
        # Weights and, as 0, sentence ends.
        for v in filter(lambda v: v is not None, map(self._words.__getitem__, PARTS.findall(text.lower()))):
            if v:
                total += v
            elif total:
                sums.append(total)
                total = 0.0
        if total:
            sums.append(total)
        return _logistic(np.array(sums) + self.base)

    def score(self, text: str | None) -> float:
        return float(1 - np.prod(1 - self.scores(text))) if text else 0.0

    def located(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) of sentences from `least` on, in code points, the end exclusive."""
        out, at = [], 0
        for m in [*ENDS.finditer(text or ""), None]:
            end = m.end() if m else len(text or "")
            z = self.base + sum(self._words[w] or 0.0 for w in re.findall(r"\w+", (text or "")[at:end].lower()))
            p = float(_logistic(np.array(z)))
            if end > at and p >= least:
                out.append((at, end, p))
            at = end
        return out


def _without_copies(rows: list[tuple[str, int]]) -> list[tuple[list[list[str]], int]]:
    """Sentences as word lists; of texts that share one of two least hashes of three words, the first."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text, label in rows:
        words = PARTS.findall(text.lower())
        plain = [w for w in words if w[0] not in ".!?\n"]
        marks = {(s, min((xxhash.xxh3_64_intdigest(" ".join(plain[i : i + 3]), s) for i in range(max(1, len(plain) - 2))), default=0)) for s in (1, 2)}
        if plain and not marks & seen:
            sentences, now = [], []
            for w in [*words, "."]:
                if w[0] in ".!?\n":
                    if now:
                        sentences.append(now)
                    now = []
                else:
                    now.append(w)
            out.append((sentences, label))
        seen |= marks
    return out


def train(rows: list[tuple[str, int]], steps: int = STEPS) -> Sentences:
    """Weights from (text, label) rows; runs on the driver over a bounded sample."""
    docs = _without_copies(rows)
    n1 = sum(y for _, y in docs)
    if not n1 or n1 == len(docs):
        return Sentences({})
    n0 = len(docs) - n1
    pos, neg = Counter(), Counter()
    for sentences, y in docs:
        (pos if y else neg).update({f for s in sentences for w in s for f in features(w)})
    least = max(3, n1 // 100)
    odds = {w: np.log(((n + 0.5) / (n1 + 1)) / ((neg[w] + 0.5) / (n0 + 1))) for w, n in pos.items() if n >= least and n * n0 > 2 * neg[w] * n1}
    names = sorted(sorted(odds, key=lambda w: (-odds[w], w))[:LIMIT])
    if not names:
        return Sentences({})
    number = {w: i for i, w in enumerate(names)}
    entry, sentence, doc_of, y = [], [], [], np.array([y for _, y in docs])
    for d, (sentences, _) in enumerate(docs):
        for s in sentences:
            if hits := [number[f] for w in s for f in features(w) if f in number]:
                entry += hits
                sentence += [len(doc_of)] * len(hits)
                doc_of.append(d)
    entry, sentence, doc_of = np.array(entry), np.array(sentence), np.array(doc_of)
    w = np.maximum(0, 3 * (np.array([odds[x] for x in names]) - 1))
    leak = -3.0
    m_w, v_w, m_c, v_c = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.clip(np.bincount(sentence, w[entry], len(doc_of)) + BASE, -30, 30)
        p = _logistic(z)
        stay = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(docs))
        lam = _logistic(np.array(leak))
        whole = np.maximum(1 - (1 - lam) * np.exp(stay), 1e-12)
        pull = np.where(y == 1, -(1 - whole) / whole, 1.0)  # d loss / d log(1 - p), negated, by document
        g_w = np.bincount(entry, (p * pull[doc_of])[sentence], len(w)) + SPARE
        g_c = float((pull * lam).sum())
        m_w, v_w = 0.9 * m_w + 0.1 * g_w, 0.99 * v_w + 0.01 * g_w**2
        m_c, v_c = 0.9 * m_c + 0.1 * g_c, 0.99 * v_c + 0.01 * g_c**2
        w = np.maximum(0, w - RATE * (m_w / (1 - 0.9**t)) / (np.sqrt(v_w / (1 - 0.99**t)) + 1e-8))
        leak -= RATE * (m_c / (1 - 0.9**t)) / (np.sqrt(v_c / (1 - 0.99**t)) + 1e-8)
    return Sentences({x: round(float(v), 6) for x, v in zip(names, w, strict=True) if v >= 0.5})


def sample(docs: DataFrame, labels: DataFrame, text: str, label: str, doc_id: str, limit: int) -> list[tuple[str, int]]:
    """Whole texts and labels of at most `limit` labelled rows, by hash of the id. A text with several labels counts with each."""
    marked = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where("i is not null and y in (0, 1)").withColumn("p", F.xxhash64(F.lit(SEED), "i"))
    chosen = marked.orderBy("p", "i", "y").limit(limit)
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(chosen), "i").select("t", "y", "p", "i").collect()
    return [(r.t, r.y) for r in sorted(rows, key=lambda r: (r.p, r.i, r.y, r.t))]


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, offending string"


def detect(df: DataFrame, model: Sentences, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted, and the offending sentences of predicted rows as start:end, comma-joined."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        texts = batch.column(2).to_pylist()
        scores = [model.score(t) for t in texts]
        spans = [",".join(f"{s}:{e}" for s, e, _ in model.located(t)) if p >= threshold else "" for t, p in zip(texts, scores, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(p >= threshold) for p in scores], pa.int32()), pa.array(spans, pa.string())],
            ["doc_id", "held_out", "score", "predicted", "offending"],
        )

    return map_arrow(df.select(F.col(doc_id).cast("long").alias("i"), F.coalesce(crc_mod(doc_id, folds) == held, F.lit(False)).alias("h"), F.col(text).cast("string").alias("t")), run, SCHEMA)


def keep_clean(df: DataFrame, model: Sentences, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that score below the threshold."""

    @F.pandas_udf("double")
    def score(texts):
        claim("toxicity")
        return texts.map(model.score)

    return df.where(score(F.col(text)) < threshold)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", limit: int = SAMPLE, folds: int = 3, held: int = 1) -> Sentences:
    """A model learned from the labels of rows that are not held out."""
    return train(sample(docs, labels.where(crc_mod(doc_id, folds) != held), text, label, doc_id, limit))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return detect(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
