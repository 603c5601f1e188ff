"""Text rules of legend names as column expressions: cleaning, core names and validity.

Patterns keep the meaning they have in browsers: white space includes the Unicode spaces, word boundaries and case folding
are ASCII, `$` is the very end. `java` spells a rule out for Spark; `re2` for engines of the RE2 family, which have no
lookahead and need a captured character instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"\t\n\x0b\f\r    -     　﻿"
#: The same characters one by one, and the marks that names neither begin nor end with.
BLANKS = "".join(c for c in map(chr, range(1 << 16)) if re.fullmatch(f"[{SPACES}]", c))
MARKS = "-–:,;"

# Section labels, care words and editorial words of legends.
LABELS = r"perennials?|annuals?|groundcovers?|ground\s*covers?|shrubs?|trees?|grasses?|ornamental\s*grasses?|vines?|ferns?|succulents?|bulbs?|evergreens?|deciduous|flowering|native|accent|specimen"
CARE = "sun|shade|water|deer|rabbit|drought|native|zone"
EDITS = "TAKE|OUT|CHANGE|REMOVE|PINKS?|DELETE|MOVE|ADD|TBD|TODO"

# The rewrites in order; pattern, replacement, whether case is ignored.
REWRITES: tuple[tuple[str, str, bool], ...] = (
    (r"[|]", "l", False),
    (r"[0O](?=[a-z])", "o", False),
    (r"\b1(?=[a-z])", "l", True),
    (r"#\d+[a-z]?\b", "", True),
    (r"\d+[\s-]?gal(lon)?s?\b", "", True),
    (r"\d+[-–]\d+['\"]\s*(o\.?c\.?)?", "", True),
    (r"\d+['\"]\s*(o\.?c\.?)?", "", True),
    (r"\d+\s*ft\.?\b", "", True),
    (r"\d+\s*in\.?\b", "", True),
    (r"\b\d+[-–]?\d*\s*(ht|height|spread|wide|tall|high)\b", "", True),
    (r"\bx\d+\b", "", True),
    (r"\b\d+x\b", "", True),
    (r"\(\d+\)", "", False),
    (r"\[\d+\]", "", False),
    (r"\bqty\.?\s*\d+", "", True),
    (rf"^({LABELS})\s*[-–:]?\s*", "", True),
    (rf"\s*[-–:]\s*({LABELS})\s*$", "", True),
    (r"\s*[-–]\s*(new|featured|native|recommended)\s*$", "", True),
    (r"\b[a-wyz]\b(?!\.)", "", True),
    (r"\b\d{1,2}\b", "", False),
    (rf"\([^)]*\b({CARE})\b[^)]*\)", "", True),
    (rf"\([^)]*\b({EDITS})\b[^)]*\)", "", True),
    (r"\[[^\]]*\]", "", False),
    (r"\{[^}]*\}", "", False),
    (r"\.\s*[=><>%»\\]", "", False),
    (r"[=><>%»\\]\s*\.", "", False),
    (r"\s+[=><>%»\\]+\s*", " ", False),
    (r"\s*[»«]+\s*", " ", False),
    (r"\s+B[RB]\s*", " ", True),
    (r"\s+B[RB]$", "", True),
    (r"\s+[A-Z]{2}\s*$", "", False),
    (r"\s+[A-Z]{2}\s+", " ", False),
    (r"\s*\d+T\.?\s*", " ", True),
    (r"\bFR[—–-]\s*", "", True),
    (r"\s+(Perennials?|Groundcovers?|Ground\s*covers?|Shrubs?\.?)\s*", " ", True),
    (r"[-–:,;]+\s*$", "", False),
    (r"^[-–:,;]+\s*", "", False),
    (r"\s*\.\s*$", "", False),
    (r"\s+", " ", False),
)
CULTIVAR = r"['\"][^'\"]+['\"]"
DESCRIPTION = r"^(dwarf|giant|miniature|variegated|golden|purple|red|blue|white|pink|yellow)\s+"

# Patterns that no name may show (pattern, whether case is ignored), and words that none starts with.
REJECTED: tuple[tuple[str, bool], ...] = (
    (r"^form\b", True),
    (r"^type\b", True),
    (r"^color\b", True),
    (r"^size\b", True),
    (r"^var\.?\b", True),
    (r"^cv\.?\b", True),
    (r"^sp\.?\b", True),
    (r"^spp\.?\b", True),
    (r"^or\b", True),
    (r"^and\b", True),
    (r"^with\b", True),
    (r"^worn\b", True),
    (r"^cond\b", True),
    (r"^soon\b", True),
    (r"^[-–—]", False),
    (r"^\(", False),
    (r"^\d", False),
    (r"^[a-z]{1,3}\b", False),
    (r"^[A-Z][a-z]?\s+[a-z]{1,2}\b", True),
    (r"^(See|Also|Note|Legend|Key|Plant|Symbol|Color)\b", True),
    (r"^Butter\s+and\b", True),
    (r"cere$", True),
    (r"EH\s", True),
)
STOP_WORDS = ("one", "two", "three", "four", "five", "none", "some", "more", "less", "this", "that", "these", "those", "the", "for", "are", "but")

_BOUND = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


_WORD_NEXT = re.compile(r"\(?(?:\\d|\[[A-Za-z]|[0-9A-Za-z])")
_WORD_BEFORE = re.compile(r"(?:\\d|[0-9A-Za-z]|\[[0-9A-Za-z-]+\])(?:[+?]|\{[0-9,]+\})*\)?\Z|[0-9A-Za-z]\?\)\Z")


def _bounds(pattern: str) -> str:
    r"""The pattern with each \b spelled out. Where it stands before or after a word character only the other side is looked at."""
    out, at = "", 0
    for m in re.finditer(r"\\b", pattern):
        before, after = pattern[: m.start()], pattern[m.end() :]
        if _WORD_NEXT.match(after):
            bound = "(?<![0-9A-Za-z_])"
        elif _WORD_BEFORE.search(before) and not before.endswith(r"\.?"):
            bound = "(?![0-9A-Za-z_])"
        else:
            bound = _BOUND
        out, at = out + pattern[at : m.start()] + bound, m.end()
    return out + pattern[at:]


def java(pattern: str, fold: bool = False) -> str:
    """The pattern in Java's dialect."""
    pattern = _bounds(pattern)
    out = re.sub(r"\[((?:\\.|[^\]\\])*)\]", lambda m: "[" + m[1].replace(r"\s", SPACES) + "]", pattern)
    out = re.sub(r"(?<!\\)\\s(?![^\[]*\])", lambda m: f"[{SPACES}]", out) if r"\s" in out else out
    out = re.sub(r"\$$", r"\\z", out)
    return ("(?i)" if fold else "") + out


def re2(pattern: str, replacement: str, fold: bool = False) -> tuple[str, str]:
    """The pattern and replacement in RE2's dialect."""
    if pattern.endswith("(?=[a-z])"):
        pattern, replacement = pattern.replace("(?=[a-z])", "([a-z])"), replacement + r"\1"
    elif pattern.endswith(r"(?!\.)"):
        pattern, replacement = pattern.replace(r"(?!\.)", r"([^.0-9A-Za-z_]|$)"), r"\1"
    return ("(?i)" if fold else "") + pattern, replacement


def rewrite(text: Column, pattern: str, replacement: str = "", fold: bool = False) -> Column:
    return F.regexp_replace(text, F.lit(java(pattern, fold)), F.lit(replacement))


def trimmed(text: Column) -> Column:
    """Without white space (Unicode's too) at either end."""
    return F.btrim(text, F.lit(BLANKS))


def _cut_marks(text: Column) -> Column:
    """Rewrite 35: without marks at the end and the white space behind them."""
    kept = F.rtrim(text, F.lit(BLANKS))
    return F.when(F.right(kept, F.lit(1)).isin(*MARKS), F.rtrim(kept, F.lit(MARKS))).otherwise(text)


def _cut_first_marks(text: Column) -> Column:
    """Rewrite 36: without marks at the beginning and the white space behind them."""
    return F.when(F.left(text, F.lit(1)).isin(*MARKS), F.ltrim(F.ltrim(text, F.lit(MARKS)), F.lit(BLANKS))).otherwise(text)


def _cut_dot(text: Column) -> Column:
    """Rewrite 37: without a dot at the end and the white space around it."""
    kept = F.rtrim(text, F.lit(BLANKS))
    return F.when(F.endswith(kept, F.lit(".")), F.rtrim(F.left(kept, F.char_length(kept) - 1), F.lit(BLANKS))).otherwise(text)


#: Rewrites at the ends of a text, looked at from there instead of at every place.
AT_ENDS = {35: _cut_marks, 36: _cut_first_marks, 37: _cut_dot}


#: Rewrites [first, end) that change nothing in a text without a match of the pattern: they are skipped together.
GATES = (
    (2, 15, "[0-9]"), (16, 17, "[-–:]"), (17, 18, "[-–]"), (19, 20, "[0-9]"), (20, 22, r"\("), (22, 23, r"\["), (23, 24, r"\{"), (24, 28, r"[=><%»«\\]"),
    (28, 30, "[bB][rRbB]"), (30, 32, "[A-Z]{2}"), (32, 33, "[0-9][tT]"), (33, 34, "[fF][rR][—–-]"), (34, 35, "[pP][eE][rR][eE]|[gG][rR][oO][uU]|[sS][hH][rR][uU]"), (38, 39, "[^ -~\xa1-\u167f]|  "),
)


def _once(text: Column, f: Callable[[Column], Column]) -> Column:
    # A lambda's variable, so that the text is computed once.
    return F.transform(F.array(text), f)[0]


def _applied(text: Column, first: int, end: int) -> Column:
    return reduce(lambda c, i: _once(c, AT_ENDS[i]) if i in AT_ENDS else rewrite(c, *REWRITES[i]), range(first, end), text)


def _gated(text: Column, first: int, end: int, needs: str) -> Column:
    return _once(text, lambda t: F.when(t.rlike(needs), _applied(t, first, end)).otherwise(t))


def clean(text: Column) -> Column:
    """A legend text without the marks of recognition errors, sizes, counts and labels; '' for null and empty ones."""
    out, at = F.coalesce(text, F.lit("")), 0
    for first, end, needs in GATES:
        out, at = _gated(_applied(out, at, first), first, end, needs), end
    return trimmed(_applied(out, at, len(REWRITES)))


def core_of(cleaned: Column) -> Column:
    """The part of a cleaned name that is looked up: without cultivar, if more than 3 characters stay, and one leading adjective."""
    plain = trimmed(rewrite(cleaned, CULTIVAR))
    return trimmed(rewrite(rewrite(F.when(F.char_length(plain) > 3, plain).otherwise(cleaned), DESCRIPTION, "", True), r"\s+", " "))


def core(text: Column) -> Column:
    return core_of(clean(text))


def _fused(patterns: tuple[tuple[str, bool], ...]) -> list[str]:
    """The patterns as few: those with and without case, each at the beginning and elsewhere, are one alternation, so that a text is scanned once for all."""
    groups: dict[tuple[bool, bool], list[str]] = {}
    for p, fold in patterns:
        groups.setdefault((fold, p.startswith("^")), []).append(java(p.removeprefix("^")))
    return [f"{'(?i)' if fold else ''}{chr(92) + 'A' if first else ''}(?:{'|'.join(some)})" for (fold, first), some in groups.items()]


def valid(name: Column) -> Column:
    """Whether a cleaned text can be a plant's name; false for null."""
    words = F.split(name, f"[{SPACES}]+")
    first = F.element_at(words, 1)
    n = F.size(words)
    short = F.size(F.filter(words, lambda w: F.char_length(w) <= 2))
    letters = F.char_length(F.regexp_replace(name, "[^a-zA-Z]", ""))
    capitals = F.size(F.regexp_extract_all(name, F.lit(f"{_BOUND}[A-Z]{_BOUND}"), F.lit(0)))
    rules = [
        F.char_length(name) >= 3,
        name.rlike(r"\A[A-Z]") | ((name == F.upper(name)) & name.rlike("[A-Z]")),
        ~name.rlike(r"[\[\]{}]"),
        *(~name.rlike(p) for p in _fused(REJECTED)),
        (n != 1) | (F.char_length(first) >= 4),
        F.char_length(first) >= 3,
        (n == 1) | (short * 2 <= n),
        letters * 2 >= F.char_length(name),
        ~F.lower(first).isin(*STOP_WORDS),
        capitals <= 2,
    ]
    return F.coalesce(reduce(lambda a, b: a & b, rules), F.lit(False))


# The same rules as SQL for engines of the RE2 family.


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_rewrite(text: str, pattern: str, replacement: str = "", fold: bool = False) -> str:
    p, r = re2(pattern, replacement, fold)
    return f"regexp_replace({text}, {_quoted(p)}, {_quoted(r)}, 'g')"


def sql_clean(text: str) -> str:
    return f"trim({reduce(lambda c, r: sql_rewrite(c, *r), REWRITES, f"coalesce({text}, '')")})"


def sql_core_of(cleaned: str) -> str:
    plain = f"trim({sql_rewrite(cleaned, CULTIVAR)})"
    return f"trim({sql_rewrite(sql_rewrite(f'CASE WHEN length({plain}) > 3 THEN {plain} ELSE {cleaned} END', DESCRIPTION, '', True), r'\s+', ' ')})"


def sql_valid(name: str) -> str:
    words = rf"regexp_split_to_array({name}, '\s+')"
    match = lambda p, fold=False: f"regexp_matches({name}, {_quoted(('(?i)' if fold else '') + p)})"
    rules = [
        f"length({name}) >= 3",
        f"({match('^[A-Z]')} OR ({name} = upper({name}) AND {match('[A-Z]')}))",
        f"NOT {match(r'[\[\]{}]')}",
        *(f"NOT {match(p, fold)}" for p, fold in REJECTED),
        f"(len({words}) <> 1 OR length({words}[1]) >= 4)",
        f"length({words}[1]) >= 3",
        f"(len({words}) = 1 OR 2 * len(list_filter({words}, lambda w: length(w) <= 2)) <= len({words}))",
        f"2 * length(regexp_replace({name}, '[^a-zA-Z]', '', 'g')) >= length({name})",
        f"lower({words}[1]) NOT IN ({', '.join(map(_quoted, STOP_WORDS))})",
        rf"len(regexp_extract_all({name}, '\b[A-Z]\b')) <= 2",
    ]
    return f"coalesce({' AND '.join(rules)}, false)"
