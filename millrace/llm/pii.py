"""Operator 1: personal data, with deobfuscation that keeps source offsets.

Base spans come from four plain patterns over the text as it is.  Then a chain of rewriting transducers
normalises look-alike letters, invisible characters, at/dot disguises and spelled digits; each keeps, for every
output character, the source range that it came from.  The same detectors read the normalised text and what they
find there is mapped back to source characters.  Base spans stay; a mapped span is added unless a span of its kind
contains it, so an identifier that is disguised in part has its plain part as base span and its whole beside it.

All passes are linear in the text's length, whatever it holds; texts are read whole.

A null or empty text has no spans.  Repeated rows are judged alike, each by itself; an empty table gives no rows.  Spans of
one start are put in order of kind, then end.  Input columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from .common import documents
from .spans import SPAN_TYPE, count_of, digests, to_arrow

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never starts inside a run of digits: the run's first digit would have matched earlier.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Whether the check digit holds."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _emails(text: str):
    """Emails from left to right: from each @, the longest local part before it and the longest domain behind it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def detect(text: str) -> list[tuple[str, int, int]]:
    """Identifiers of a text, as (kind, start, end), by start and then kind."""
    found = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m[0].split("."))):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


# --- transducers -----------------------------------------------------------------------------------------------

#: Letters of other scripts that look like a Latin letter.
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕԁһӏԛԝАВЕКМНОРСТУХІЈЅαερονικυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxijsdhlqwABEKMHOPCTYXIJSaepovikuxABEZHIKMNOPTYX",
        strict=True,
    )
)
_INVISIBLE = frozenset("\u00ad\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\ufeff")
_DOTS = frozenset("\u2024\u3002\uff0e\uff61\u06d4")
_ODD = re.compile(
    "[\u00ad\u0370-\u052f\u0660-\u0669\u06d4\u06f0-\u06f9\u0966-\u096f\u180e\u200b-\u200f\u2010-\u2015\u2024\u2060-\u2064\u2070-\u209f\u2212"
    "\u2460-\u249b\u24b6-\u24ff\u3002\ufe00-\ufeff\uff00-\uff65\U0001d400-\U0001d7ff\U0001f100-\U0001f1ff]"
)
_AT = r"(?:at|arroba|arobase)"
_DOT = r"(?:dot|punkt|point|punto)"
_OPEN, _CLOSE = r"\s{0,3}[\[({<]\s{0,3}", r"\s{0,3}[\])}>]\s{0,3}"
#: Rules that a disguise must match before it is rewritten; words alone count only between a name and a dotted domain.
_BRACKET_AT = re.compile(rf"(?i){_OPEN}(?:{_AT}|@){_CLOSE}")
_BRACKET_DOT = re.compile(rf"(?i){_OPEN}(?:{_DOT}|\.){_CLOSE}")
#: A label's characters up to the next disguise, so that each is read once.
_LABEL = rf"(?:(?![\x20_-](?:{_AT}|{_DOT})[\x20_-])[A-Za-z0-9-])"
_WORD_AT = re.compile(rf"(?i)(?<=[A-Za-z0-9])[\x20_-]{_AT}[\x20_-](?={_LABEL}++(?:{_OPEN}{_DOT}{_CLOSE}|[\x20_-]{_DOT}[\x20_-])[A-Za-z])")
#: A bare "at" before a domain with plain dots is prose ("look at example.com"), unless the name has what words have not.
_TOP = r"(?:com|org|net|edu|gov|info|biz|io|eu|de|fr|es|it|uk|us|at|ch|nl|be|mx|ar|example|test|local|invalid)"
_NAME_AT = re.compile(
    rf"(?i)(?<![A-Za-z0-9._%+-])(?=[A-Za-z%+-]*+[._0-9])[A-Za-z0-9%+_-]++(?:\.[A-Za-z0-9%+_-]++)*+(?P<at>\x20{_AT}\x20)"
    rf"(?=[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.{_TOP}(?![A-Za-z0-9-]))"
)
_WORD_DOT = re.compile(rf"(?i)(?<=[A-Za-z0-9])[\x20_-]{_DOT}[\x20_-](?=[A-Za-z]{{2,}}(?![A-Za-z]))")
#: What may stand between an @ and a bare dot word: labels, dots and other dot words.
_DOMAIN_RUN = re.compile(rf"(?i)@(?:{_LABEL}|\.)*+(?:[\x20_-]{_DOT}[\x20_-](?:{_LABEL}|\.)*+)*+")
_AT_HINT = re.compile(rf"(?i)[\[({{<\x20_-](?:{_AT}|@)[\])}}>\x20_-]|[\[({{<]\s{{1,3}}(?:{_AT}|@)")
#: Digits as words, in four languages.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_DIGIT_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:plus[\x20,.-]{{1,2}})?(?:{_DIGIT_WORD}|[0-9]+)(?:[\x20,.-]{{1,2}}(?:{_DIGIT_WORD}|dot|[0-9]+))+(?!\w)")
_SPELLED_HINT = re.compile(rf"(?i)(?<!\w)(?:{_DIGIT_WORD})[\x20,.-]{{1,2}}(?:{_DIGIT_WORD}|[0-9])|[0-9]\x20dot\x20[0-9]")
_UNIT = re.compile(rf"(?i)plus|dot|{_DIGIT_WORD}|[0-9]+|[\x20,.-]+")
_LEET = re.compile(r"(?<=[0-9])[OolI|](?=[0-9])")


class Tape:
    """A text with, for each of its characters, the source range that it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.changed = text, range(len(text)), range(1, len(text) + 1), False

    def rewrite(self, edits) -> None:
        """edits: (start, end, replacement) from left to right; each replacement character stands for the whole range."""
        out, starts, ends, at = [], [], [], 0
        for s, e, new in edits:
            out += [self.text[at:s], new]
            starts += [*self.start[at:s], *[self.start[s]] * len(new)]
            ends += [*self.end[at:s], *[self.end[e - 1]] * len(new)]
            at = e
        if out:
            self.text = "".join(out) + self.text[at:]
            self.start, self.end, self.changed = [*starts, *self.start[at:]], [*ends, *self.end[at:]], True

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.start[start], self.end[end - 1]


def _plain(char: str) -> str:
    if char in _INVISIBLE:
        return ""
    if char in _DOTS:
        return "."
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    if unicodedata.category(char) == "Pd" or char == "\u2212":
        return "-"
    if (digit := unicodedata.digit(char, None)) is not None:
        return str(digit)
    wide = unicodedata.normalize("NFKC", char)
    return wide if wide.isascii() else char


def _spelled(tape: Tape):
    for m in _SPELLED.finditer(tape.text):
        units = [(u[0].lower(), u) for u in _UNIT.finditer(m[0])]
        words, dots = sum(u in DIGIT_WORDS for u, _ in units), sum(u == "dot" for u, _ in units)
        digits = words + sum(len(u) for u, _ in units if u[0].isdigit())
        # four digit words, or a dot beside one, or an address of four numbers, or two words in a number as long as a card's
        if words < 4 and not (dots and words) and dots < 3 and not (words > 1 and digits >= 12):
            continue
        for u, at in units:
            new = DIGIT_WORDS.get(u) or {"plus": "+", "dot": "."}.get(u) or (u if u[0].isdigit() else "")
            if new != u:
                yield m.start() + at.start(), m.start() + at.end(), new


def _edits(pattern: re.Pattern, new: str):
    return lambda tape: [(m.start(), m.end(), new) for m in pattern.finditer(tape.text)]


#: (what a text must hold for it, transducer), in the order in which they are composed.
TRANSDUCERS = (
    (_ODD, lambda tape: [(m.start(), m.end(), p) for m in _ODD.finditer(tape.text) if (p := _plain(m[0])) != m[0]]),
    (_AT_HINT, _edits(_BRACKET_AT, "@")),
    (_AT_HINT, _edits(_WORD_AT, "@")),
    (_AT_HINT, lambda tape: [(*m.span("at"), "@") for m in _NAME_AT.finditer(tape.text)]),
    (_BRACKET_DOT, _edits(_BRACKET_DOT, ".")),
    (re.compile("@"), lambda tape: _word_dots(tape.text)),
    (_SPELLED_HINT, _spelled),
    (_LEET, lambda tape: [(m.start(), m.end(), "0" if m[0] in "Oo" else "1") for m in _LEET.finditer(tape.text)]),
)


def _word_dots(text: str) -> list[tuple[int, int, str]]:
    """Bare dot words, where they follow an @ without other words between."""
    runs = [m.span() for m in _DOMAIN_RUN.finditer(text)]
    starts = [s for s, _ in runs]
    inside = lambda m: (k := bisect_right(starts, m.start()) - 1) >= 0 and m.end() <= runs[k][1]
    return [(m.start(), m.end(), ".") for m in _WORD_DOT.finditer(text) if inside(m)]


def normalise(text: str) -> Tape:
    """Run the transducers over a text."""
    tape = Tape(text)
    for hint, transducer in TRANSDUCERS:
        if hint.search(tape.text):
            tape.rewrite(list(transducer(tape)))
    return tape


def find(text: str | None) -> list[tuple[str, int, int, bool]]:
    """All spans of a text, as (kind, start, end, base), by start and then kind."""
    if not text:
        return []
    found = [(*x, True) for x in detect(text)]
    tape = normalise(text)
    if tape.changed:
        # Base spans of a kind do not overlap and mapped ones move forward: only the last that starts before can contain one.
        base: dict[str, tuple[list, list]] = {k: ([], []) for k in KINDS}
        for kind, s, e, _ in found:
            base[kind][0].append(s)
            base[kind][1].append(e)
        last = dict.fromkeys(KINDS, (0, 0))
        for kind, s, e in detect(tape.text):
            start, end = tape.source(s, e)
            starts, ends = base[kind]
            k = bisect_right(starts, start) - 1
            if (k < 0 or ends[k] < end) and not (last[kind][0] <= start and end <= last[kind][1]):
                last[kind] = start, end
                found.append((kind, start, end, False))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


@arrow_udf(SPAN_TYPE)
def pii_spans(text: pa.Array) -> pa.Array:
    """Spans of personal data in a text column."""
    return to_arrow([find(t.as_py()) for t in text])


@arrow_udf(StringType())
def redact_pii(text: pa.Array) -> pa.Array:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, with the first
    one's kind.  Null stays null."""
    return pa.array([redact(t.as_py()) for t in text], pa.string())


def redact(text: str | None) -> str | None:
    if not text or not (spans := find(text)):
        return text
    out, at = [], 0
    for kind, s, e, _ in spans:
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """Documents with redacted text; the length column, where there is one, follows the new text."""
    out = docs.withColumn(text, redact_pii(F.col(text)))
    return out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType)) if n_chars in docs.columns else out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id and the spans of personal data in its text."""
    return docs.select(F.col(id_col), pii_spans(F.col(text_col)).alias("found"))


def digest(found: DataFrame, kinds: tuple[str, ...], id_col: str = "doc_id") -> DataFrame:
    counts: list[Column] = [count_of("found", k).alias(f"n_{k}") for k in kinds]
    return found.select(id_col, *counts, *digests("found"), F.size(F.filter("found", lambda s: ~s["base"])).cast("long").alias("n_method"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of ``documents``."""
    return digest(find_pii(documents(spark, sf_dir)), KINDS)
