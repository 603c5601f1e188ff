"""Secret scans: fixed patterns, and values in credential contexts that would cost many guesses.

The guess cost of a value is the least sum, over its segmentations, of log10 costs of words, dates, repeats, keyboard
walks and brute-force spans, found by dynamic programming from left to right. A value that stands where a credential
stands and costs at least `least` is a span of kind `guess`. Where only spaces part an unquoted value from the credential's
name, a value of letters only must also have a lower-case letter before an upper-case one ("bearer qZxVbTrW"), as a word of
prose has not ("token distribution").

Whole texts are scanned, one at a time, inside mapInArrow; nothing is shuffled. Null and empty texts have no spans;
repeated rows give repeated results; a null id stays null; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.llm._shared import claim, map_arrow

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")
_NAME = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|bearer|auth)"
#: Names that announce a credential, more than those of ASSIGN, and values with any printable characters; of an unquoted value the
#: first one. Only the name is consumed, so that a name which stands in the place of another one's value has its own value. Blanks are
#: taken without going back, so the time is in proportion to the text.
CONTEXT = re.compile(rf"""(?ai){_NAME}(?=["']?(\x20*+(?::=|=>|[:=])|\x20++is\x20|\x20)\x20*+(?:"([^"\s]{{6,}})"|'([^'\s]{{6,}})'|([^\s"',;])))""")
#: A name with its separator: an unquoted value ends before the next one.
NAMED = re.compile(rf"(?ai){_NAME}(?::=|=>|[:=])")
_END = re.compile(r"""[\s"',;]""")
#: Letters that are no word of prose; asked of unquoted values of letters only after a bare space.
MIXED = re.compile(r"[^\W\d_A-Z][A-Z]")
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth")
#: log10 of the guesses from which a value counts as a secret.
LEAST = 10.0

# Common parts of chosen passwords, commonest first; a word's rank is its place.
WORDS = (
    "password admin welcome login letmein master dragon monkey shadow sunshine princess football baseball superman batman "
    "iloveyou trustno secret token access user root test guest demo example sample default changeme change server client system "
    "network private public service account manager database backup mysql oracle postgres redis docker github google amazon azure "
    "apple summer winter spring autumn monday friday january february march april june july august september october november december "
    "love hello world computer internet company office home house family michael jennifer jordan thomas robert daniel charlie andrew "
    "black white blue green orange purple silver golden yellow happy lucky power magic star tiger eagle lion wolf bear horse dog cat "
    "correct battery staple hunter killer soccer hockey golf music guitar piano flower cookie cheese pepper ginger coffee chocolate "
    "your here none null true false value string text name key code pass word safe data file"
).split()
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST = max(map(len, WORDS))
LEET = str.maketrans("@4301!5$7", "aaeoiisst")
DATES = (
    re.compile(r"(?a)(?=((?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01])))"),
    re.compile(r"(?a)(?=((?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d))"),
    re.compile(r"(?a)(?=((?:19|20)\d\d))"),
)
DAYS, YEARS, KEYS = 365 * 120, 120, 4 * sum(map(len, ROWS))
_NEXT = {a + b for row in ROWS for a, b in (*zip(row, row[1:]), *zip(row[1:], row))}


def _classes(part: str) -> int:
    """Size of the alphabet that a value seems to be drawn from."""
    if re.fullmatch(r"[0-9]+", part):
        return 10
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", part):
        return 16
    return sum(n for n, p in ((26, r"[a-z]"), (26, r"[A-Z]"), (10, r"[0-9]"), (33, r"[^A-Za-z0-9]")) if re.search(p, part))


def _cheapest(stack: list[tuple[float, int]], end: int) -> tuple[float, int]:
    """Price and start of the cheapest segment of a run that ends at `end`. `stack` has (price at the start, start), latest starts last.

    A segment's own cost is log10 of its length, so an earlier start gains on a later one as both grow: one that has caught up with those above
    it stays ahead of them, and they go for good."""
    top = stack[-1][0] + math.log10(end - stack[-1][1]), stack[-1][1]
    while len(stack) > 1 and (below := stack[-2][0] + math.log10(end - stack[-2][1])) <= top[0]:
        stack.pop()
        top = below, stack[-1][1]
    return top


def _push(stack: list[tuple[float, int]], price: float, start: int, end: int) -> None:
    """Add a start. `end` is the first end it can have; one that is not cheaper there never will be. A start between two others that would
    be caught up with by the earlier one before it catches up with the later one is never the cheapest."""
    if stack and _cheapest(stack, end)[0] <= price + math.log10(end - start):
        return
    while len(stack) > 1 and _meet(stack[-2], stack[-1]) <= _meet(stack[-1], (price, start)):
        stack.pop()
    stack.append((price, start))


def _meet(early: tuple[float, int], late: tuple[float, int]) -> float:
    """The end from which a segment with the earlier start is as cheap as one with the later start."""
    if early[0] >= late[0] + 300:
        return math.inf
    ratio = 10 ** (late[0] - early[0])  # of the lengths, early to late
    return math.inf if ratio <= 1 else (ratio * late[1] - early[1]) / (ratio - 1)


def guess_cost(value: str) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses that the cheapest segmentation of a value takes, and its (kind, start, end) segments.

    Kinds: word (rank in the list, twice for capitals, twice for leet), date, repeat (a character at least three times),
    walk (at least three neighbours in a row of keys or of the alphabet) and brute. Each segment but the first also costs
    log10(2). An empty value costs 0. Time is in proportion to the length."""
    n = len(value)
    if not n:
        return 0.0, []
    low = value.lower()
    low = low if len(low) == n else value
    plain = low.translate(LEET)
    per, more = math.log10(max(2, _classes(value))), math.log10(2)
    ends: dict[int, list[tuple[int, str, float]]] = {}

    def offer(kind: str, start: int, end: int, cost: float) -> None:
        ends.setdefault(end, []).append((start, kind, cost))

    for text, leet in ((low, 0.0), *(((plain, more),) if plain != low else ())):
        for start in range(n):
            for end in range(start + 3, min(n, start + LONGEST) + 1):
                if rank := RANK.get(text[start:end]):
                    offer("word", start, end, math.log10(rank) + leet + (more if value[start:end] != low[start:end] else 0))
    for date, guesses in zip(DATES, (DAYS, DAYS, YEARS), strict=True):
        for m in date.finditer(value):
            offer("date", *m.span(1), math.log10(guesses))
    best: list[tuple[float, int, str]] = [(0.0, 0, "")]
    before = lambda at: best[at][0] + (more if at else 0.0)  # noqa: E731  what a segment that starts here adds to
    # A brute-force span grows by one character at the alphabet's price; open_ is the cheapest that ends here.
    open_: tuple[float, int] = (math.inf, 0)
    runs = [("repeat", per, [], 0), ("walk", math.log10(KEYS), [], 0)]
    for i in range(1, n + 1):
        open_ = min(open_, (before(i - 1), i - 1))
        open_ = (open_[0] + per, open_[1])
        choice = (open_[0], open_[1], "brute")
        for start, kind, cost in ends.get(i, ()):
            choice = min(choice, (before(start) + cost, start, kind))
        for at, (kind, price, stack, first) in enumerate(runs):
            if i > 1 and not (low[i - 2] == low[i - 1] if kind == "repeat" else low[i - 2 : i] in _NEXT):
                stack, first = [], i - 1
                runs[at] = kind, price, stack, first
            if i - 3 >= first:
                _push(stack, before(i - 3), i - 3, i)
                cost, start = _cheapest(stack, i)
                choice = min(choice, (cost + price, start, kind))
        best.append(choice)
    parts, at = [], n
    while at:
        _, start, kind = best[at]
        parts.append((kind, start, at))
        at = start
    return best[n][0], parts[::-1]


def base_spans(text: str, low: str | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind."""
    low = text.lower() if low is None else low
    out = []
    if any(h in low for h in ("passw", "secret", "token", "api")):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def context_values(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the values of 6 characters or more that credential names announce."""
    named = [m.start() for m in NAMED.finditer(text)]
    for m in CONTEXT.finditer(text):
        if m.lastindex < 4:
            yield m.span(m.lastindex)
            continue
        start, after = m.start(4), bisect_right(named, m.start(4) - 1)
        limit = named[after] if after < len(named) else len(text)
        end = found.start() if (found := _END.search(text, start, limit)) else limit
        value = text[start:end]
        if end - start >= 6 and not (m[1] == "\x20" and value.isalpha() and not MIXED.search(value)):
            yield start, end


def all_spans(text: str, least: float = LEAST) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans, and these with the spans of costly values in credential contexts, both in order."""
    low = text.lower()
    base = base_spans(text, low)
    found = set()
    if any(h in low for h in HINTS):
        values = list(context_values(text))
        values += [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        found = {(s, e, "guess") for s, e in set(values) if guess_cost(text[s:e])[0] >= least}
    return base, sorted([*base, *found], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """The text with overlapping spans joined and each replaced by `mark`; in an assignment only the value goes."""
    out, at = [], 0
    for start, end, kind in sorted((s + ASSIGN.match(text, s).start(2) - s if k == "assign" else s, e, k) for s, e, k in spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(df: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = LEAST) -> DataFrame:
    """For each row: doc_id, counts of the base kinds, digest of the base spans, and all spans, base and added."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        claim("secrets")
        rows = []
        for text in batch.column(1).to_pylist():
            base, every = all_spans(text or "", least)
            kinds = [k for _, _, k in base]
            rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )

    return map_arrow(df.select(F.col(doc_id).cast("long"), F.col(text).cast("string")), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]", least: float = LEAST) -> DataFrame:
    """All rows and columns, with the secrets of `text` replaced; n_chars, where there is such a column, follows the text."""

    @F.pandas_udf("string")
    def clean(texts):
        import pandas as pd

        claim("secrets")
        return pd.Series([t if t is None or not (s := all_spans(t, least)[1]) else redacted(t, s, mark) for t in texts], dtype=object)

    columns = df.columns
    out = df.withColumn(text, clean(F.col(text)))
    return out.withColumn("n_chars", F.char_length(F.col(text)).cast(df.schema["n_chars"].dataType)).select(*columns) if "n_chars" in columns else out


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
