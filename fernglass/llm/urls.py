"""URL filters: a list of rules, and for urls that no rule fits the ratio of two character language models.

Two variable-order Markov models (contexts of up to `ORDER` characters, Witten-Bell smoothing down to a uniform
alphabet) are learned from accepted and from rejected urls: those that the rules allow and block, scheme, query and
fragment left aside as the rules' hosts and paths do. A url's score is the difference of its two log-likelihoods a
character. The models count all distinct ruled urls, whatever their number: contexts with their next characters are summed in a
table, smoothed there from short to long contexts, and joined with the characters of the distinct urls. All distinct ruled urls calibrate the
ratio too: in the order of their hashes, models of each kind's even ones score the odd ones, and the cut is the middle of the scores
between which the balanced error is least. Ranks, scores and running counts are tables; the driver gets two rows and counts of ranges. Only where a caller gives a `limit`, at most so many urls of each kind calibrate, on the driver.
Logarithms are summed as whole numbers of 1e-12, so their order does not matter.

Null urls and urls without `://` have empty host and path, no rule and the score 0 of an empty string: they
are blocked only if the cut lies above 0. If either kind of url is missing every score is 0 and the verdict `allow`.
Repeated rows give repeated results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernglass.llm._shared import map_arrow, materialize

ORDER, SEED, MOST_RULES = 5, 3, 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; and from there up to ? or #."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("__url"))).otherwise("")
    host = F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*(/[^?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule as host + path, and its verdict; null without one. At equal length a block goes first.

    Rules become one expression each, so their number is checked: at most `MOST_RULES`."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are allowed")
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


class Markov:
    """Counts of characters after contexts of 0 to `order` characters; texts start with `order` marks and end with one."""

    def __init__(self, texts: list[str], order: int = ORDER, alphabet: int = 256):
        self.order, self.alphabet = order, alphabet
        self.after: dict[str, dict[str, int]] = {}
        for text in texts:
            t = "\x02" * order + text + "\x03"
            for i in range(order, len(t)):
                for k in range(order + 1):
                    row = self.after.setdefault(t[i - k : i], {})
                    row[t[i]] = row.get(t[i], 0) + 1
        self._rows = {c: (row, sum(row.values()), len(row)) for c, row in self.after.items()}
        self._known: dict[tuple[str, str], float] = {}

    def _probability(self, context: str, char: str) -> float:
        p = 1 / self.alphabet
        for k in range(len(context) + 1):
            row = self._rows.get(context[len(context) - k :])
            if row is None:
                break
            counts, total, kinds = row
            p = (counts.get(char, 0) + kinds * p) / (total + kinds)
        return p

    def likelihood(self, text: str) -> float:
        """log-likelihood a character, the end mark included."""
        t, total, n = "\x02" * self.order + text + "\x03", 0.0, self.order
        for i in range(n, len(t)):
            key = (t[i - n : i], t[i])
            if (p := self._known.get(key)) is None:
                if len(self._known) > 200_000:
                    self._known.clear()
                p = self._known[key] = math.log(self._probability(*key))
            total += p
        return total / (len(t) - n)

    def __reduce__(self):
        return _restored, (self.order, self.alphabet, self.after)


def _restored(order: int, alphabet: int, after: dict) -> Markov:
    model = Markov([], order, alphabet)
    model.after = after
    model._rows = {c: (row, sum(row.values()), len(row)) for c, row in after.items()}
    return model


class Ratio:
    """Two models, the cut on their difference and the slope of a logistic curve through it."""

    def __init__(self, accepted: Markov, rejected: Markov, cut: float, slope: float):
        self.accepted, self.rejected, self.cut, self.slope = accepted, rejected, cut, slope

    def score(self, text: str) -> float:
        """Above 0: like the rejected."""
        return self.rejected.likelihood(text) - self.accepted.likelihood(text) if text else 0.0

    def blocked(self, text: str) -> float:
        """Calibrated probability that the text is one to block."""
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * (self.score(text) - self.cut)))))


def train(accepted: list[str], rejected: list[str]) -> Ratio | None:
    """Models from the even texts of each list and calibration on the odd ones; the models then take all texts."""
    if not accepted or not rejected:
        return None
    half = Ratio(Markov(accepted[::2]), Markov(rejected[::2]), 0.0, 1.0)
    scores = sorted([(half.score(t), 0) for t in accepted[1::2]] + [(half.score(t), 1) for t in rejected[1::2]])
    n1 = sum(y for _, y in scores)
    n0 = len(scores) - n1
    cut, spread = 0.0, 1.0
    if n0 and n1:
        # Going up: below the cut are allowed ones rightly, blocked ones wrongly.
        right, best = 0.0, (-1.0, 0.0)
        for (s, y), (after, _) in zip(scores, [*scores[1:], (scores[-1][0], 0)], strict=True):
            right += -1 / n1 if y else 1 / n0
            best = max(best, (right, (s + after) / 2))
        cut = best[1]
        mean = [sum(s for s, y in scores if y == k) / n for k, n in ((0, n0), (1, n1))]
        spread = max(1e-3, math.sqrt(sum((s - mean[y]) ** 2 for s, y in scores) / len(scores)))
    return Ratio(Markov(accepted), Markov(rejected), cut, 2 / spread)


def sample(parts: DataFrame, kind: str, limit: int) -> list[str]:
    """At most `limit` distinct host + path strings with the verdict `kind`, by hash."""
    found = parts.where(F.col("rule_verdict") == kind).select(F.concat("host", "path").alias("t")).distinct()
    return [r.t for r in found.orderBy(F.xxhash64(F.lit(SEED), "t"), "t").limit(limit).collect()]


def _grams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """A row (a, b, kind, g) for each character of the texts and their end marks: g ends in it, after `order` characters."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for at in range(0, len(columns[0]), 500):
            rows = []
            for a, b, kind, text in zip(*(c[at : at + 500] for c in columns), strict=True):
                t = "\x02" * order + text + "\x03"
                rows += [(a, b, kind, t[i : i + order + 1]) for i in range(len(t) - order)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["a", "b", "kind", "g"])

    return map_arrow(texts.select("a", "b", "kind", "t"), run, "a long, b long, kind string, g string")


def ratios(counts: DataFrame, order: int = ORDER, alphabet: int = 256) -> DataFrame:
    """(g, d) for counts (g, allow, block): log-probability of g's last character after the others in the model of the
    blocked less that in the model of the allowed, in units of 1e-12; both as `Markov` has them."""
    shorter = None
    for k in range(order + 1):
        level = counts.groupBy(F.expr(f"right(g, {k + 1})").alias("g")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        same = Window.partitionBy(F.expr(f"left(g, {k})"))
        level = level.withColumns({f"{n}_{kind}": F.sum(v).over(same) for kind in ("allow", "block") for n, v in (("total", F.col(kind)), ("kinds", (F.col(kind) > 0).cast("long")))})
        if shorter is None:
            level = level.withColumns({"q_allow": F.lit(1 / alphabet), "q_block": F.lit(1 / alphabet)})
        else:
            level = level.withColumn("s", F.expr(f"right(g, {k})")).join(shorter, "s")
        p = {kind: F.when(F.col(f"total_{kind}") > 0, (F.col(kind) + F.col(f"kinds_{kind}") * F.col(f"q_{kind}")) / (F.col(f"total_{kind}") + F.col(f"kinds_{kind}"))).otherwise(F.col(f"q_{kind}")) for kind in ("allow", "block")}
        shorter = level.select(F.col("g").alias("s"), *(v.alias(f"q_{kind}") for kind, v in p.items()))
    return shorter.select(F.col("s").alias("g"), F.round((F.log("q_block") - F.log("q_allow")) * 1e12).cast("long").alias("d"))


def _texts(parts: DataFrame) -> DataFrame:
    """(a, b, kind, t) of each distinct host + path; a and b are hashes."""
    texts = parts.select(F.concat("host", "path").alias("t"), F.col("rule_verdict").alias("kind")).distinct()
    return texts.select(F.xxhash64("t").alias("a"), F.xxhash64(F.lit(SEED), "t").alias("b"), "kind", "t")


def halves(texts: DataFrame) -> DataFrame:
    """The ruled texts with `odd`: whether their place among those of their kind, by hash, from 0, is odd. Places are counted in 4,096 parts of the hashes."""
    ruled = texts.where("kind is not null").withColumn("part", F.shiftright("b", 52))
    before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ruled.groupBy("kind", "part").agg(F.count("*").alias("n")).select("kind", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("kind", "part").orderBy("b", "t")) - 1
    return ruled.withColumn("inside", inside).join(starts, ["kind", "part"]).select("a", "b", "kind", "t", ((F.col("start") + F.col("inside")) % 2 == 1).alias("odd"))


def best_cut(scored: DataFrame) -> tuple[float, float]:
    """The cut between scores (score, blocked) below which the allowed less the blocked, as shares of their kinds, are most, the higher at a tie; and the scores'
    spread around their kinds' means. Scores are dealt by ranges, in which running counts begin with those of the ranges before."""
    ranged = materialize(scored.repartitionByRange("score").withColumn("r", F.spark_partition_id()), "urls")
    sums = sorted(ranged.groupBy("r").agg(F.count_if(~F.col("blocked")).alias("n0"), F.count_if("blocked").alias("n1"), F.min("score").alias("first")).collect(), key=lambda s: s.r)
    n0, n1 = sum(s.n0 for s in sums), sum(s.n1 for s in sums)
    if not n0 or not n1:
        return 0.0, 1.0
    starts, below = [], (0, 0)
    for s, after in zip(sums, [*sums[1:], None], strict=True):
        starts.append((s.r, *below, after.first if after else None))
        below = below[0] + s.n0, below[1] + s.n1
    order = Window.partitionBy("r").orderBy("score", "blocked")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.join(ranged.sparkSession.createDataFrame(starts, "r int, b0 long, b1 long, next double"), "r")
    count = lambda kind, start: F.col(start) + F.sum(kind.cast("long")).over(upto)
    right = count(~F.col("blocked"), "b0").cast("decimal(19,0)") * n1 - count(F.col("blocked"), "b1").cast("decimal(19,0)") * n0
    after = F.coalesce(F.lead("score").over(order), F.col("next"), F.col("score"))
    cut = rows.select(F.struct(right.alias("right"), ((F.col("score") + after) / 2).alias("cut")).alias("best")).agg(F.max("best").alias("best")).first().best.cut
    wide = ranged.groupBy("blocked").agg((F.var_pop("score") * F.count("*")).alias("v")).agg(F.sum("v")).first()[0]
    return cut, max(1e-3, round(math.sqrt(wide / (n0 + n1)), 12))


def calibrated(parts: DataFrame) -> tuple[float, float] | None:
    """Cut and slope, as `train` finds them, from all distinct ruled texts; None if a kind has none."""
    texts = materialize(halves(_texts(parts)), "urls")
    if texts.select("kind").distinct().count() < 2:
        return None
    grams = _grams(texts.withColumn("kind", F.when(F.col("odd"), F.concat(F.lit("odd_"), "kind")).otherwise(F.col("kind"))))
    counts = materialize(grams.groupBy("g").agg(*(F.count_if(F.col("kind") == kind).alias(kind) for kind in ("allow", "block"))), "urls")
    odd = grams.where(F.startswith("kind", F.lit("odd_"))).join(ratios(counts), "g").groupBy("a", "b", "kind").agg((F.sum("d") / 1e12 / F.count("*")).alias("score"))
    cut, spread = best_cut(odd.select("score", (F.col("kind") == "odd_block").alias("blocked")))
    return cut, 2 / spread


def scores(parts: DataFrame) -> DataFrame:
    """(t, score) of each distinct host + path but the empty one, under the models of all ruled ones."""
    texts = _texts(parts).where("t != ''")
    grams = _grams(texts)
    counts = materialize(grams.groupBy("g").agg(*(F.count_if(F.col("kind") == kind).alias(kind) for kind in ("allow", "block"))), "urls")
    sums = grams.select("a", "b", "g").join(ratios(counts), "g").groupBy("a", "b").agg((F.sum("d") / 1e12 / F.count("*")).alias("score"))
    return texts.select("a", "b", "t").join(sums, ["a", "b"]).select("t", "score")


def judge(df: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, url: str = "url", page_id: str = "page_id", limit: int | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the models' probability that the url is one to block.

    Without a fitting rule a url is blocked when that probability is above `threshold`."""
    host, path = host_and_path(F.col("__url"))
    split = df.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("__url")).select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    parts = split.withColumns({"rule": name, "rule_verdict": verdict})
    if limit is None:
        line = calibrated(parts)
    else:
        ratio = train(sample(parts, "allow", limit), sample(parts, "block", limit))
        line = ratio and (ratio.cut, ratio.slope)
    if line is None:
        judged = parts.withColumn("block_score", F.lit(0.0))
    else:
        judged = parts.withColumn("t", F.concat("host", "path")).join(scores(parts), "t", "left")
        x = F.lit(line[1]) * (F.coalesce("score", F.lit(0.0)) - F.lit(line[0]))
        judged = judged.withColumn("block_score", 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x)))))
    found = F.coalesce("rule_verdict", F.when(F.col("block_score") > threshold, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", found.alias("verdict"), "block_score")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
