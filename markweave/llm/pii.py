"""Personal data in plain and disguised writing, with places in the source text.

A text goes through transducers, each of which writes a plainer text and remembers what it
replaced: letters and digits of other scripts that look like ASCII ones, invisible
characters, character references, spelled digits, and "at" and "dot" in words or brackets.
The same detectors read the source text and its plain form; what they find in the plain form
is mapped back through all steps to the source's code points. Spans of the source text
always stay; a span of the plain form is added if the source has not the same one, nor one
of its kind around it.

Everything is linear in a text: detectors walk from each @, digit run or + once.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markweave.llm.common import text_of

KINDS = ("email", "ip", "card", "phone")

# Letters of Greek and Cyrillic that look like Latin ones.
LOOK_ALIKE = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "ɡ": "g", "ı": "i",
}
# Signs that stand for a hyphen or a dot, and characters that can't be seen.
HYPHENS, DOTS, INVISIBLE = "‐‑‒–—―−﹣", "․。｡․・", "­​‌‍⁠﻿"
# The digits' names in the four languages of the corpus, and those of + and signs.
DIGIT_WORDS = {
    "0": "zero oh null zéro cero", "1": "one eins un uno", "2": "two zwei zwo deux dos", "3": "three drei trois tres", "4": "four vier quatre cuatro",
    "5": "five fünf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete", "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
PLUS_WORDS, AT_WORDS, DOT_WORDS, TIMES = "plus más", "at arroba chez bei arobase", "dot punkt point punto", {"double": 2, "triple": 3}
#: So many digits on end must be spelled before words are read as digits.
SPELLED_RUN = 7

DIGIT_OF = {w: d for d, names in DIGIT_WORDS.items() for w in names.split()}


def _any(words: str) -> str:
    return "|".join(sorted(words.split(), key=len, reverse=True))


_NUMBER = rf"(?:(?:{'|'.join(TIMES)})[ ])?(?:{_any(' '.join(DIGIT_OF))})(?![^\W_])|[0-9](?![^\W_])"
_GAP = rf"(?:[ ,-]{{1,2}}|[ ]?\.[ ]?|[ ](?:{_any(DOT_WORDS)})[ ])"
_SPELLED = re.compile(rf"(?<![^\W_])(?:(?P<plus>{_any(PLUS_WORDS)})[ ]|(?P<sign>\+)[ ]?)?(?:{_NUMBER})(?:{_GAP}(?:{_NUMBER}))+", re.IGNORECASE)
_PART = re.compile(rf"(?P<times>{'|'.join(TIMES)})[ ](?P<many>{_any(' '.join(DIGIT_OF))})|(?P<word>{_any(' '.join(DIGIT_OF))})|(?P<digit>[0-9])|(?P<dot>[ ]?\.[ ]?|[ ](?:{_any(DOT_WORDS)})[ ])|(?P<gap>[ ,-]+)", re.IGNORECASE)
_HINT = re.compile(rf"(?<![^\W_])(?:{_any(' '.join(DIGIT_OF))})[ ,.-]{{1,2}}(?:{_any(' '.join(DIGIT_OF))}|[0-9]|{'|'.join(TIMES)})(?![^\W_])", re.IGNORECASE)
_REFERENCE = re.compile(r"&(?:#0*(?P<ten>[0-9]{1,7})|#[xX]0*(?P<hex>[0-9A-Fa-f]{1,6})|(?P<name>commat|period|plus|hyphen|nbsp));")
_NAMED = {"commat": "@", "period": ".", "plus": "+", "hyphen": "-", "nbsp": " "}
_OPEN, _SHUT = r"[ ]{0,3}[\[({<]{1,2}[ ]{0,3}", r"[ ]{0,3}[\])}>]{1,2}[ ]{0,3}"
_BRACKETED = re.compile(rf"(?<=[A-Za-z0-9_%+-]){_OPEN}(?:(?P<at>{_any(AT_WORDS)}|@)|(?P<dot>{_any(DOT_WORDS)}|\.)){_SHUT}(?=[A-Za-z0-9])", re.IGNORECASE)
#: In words, "at" counts only before a name with a dot in words, and "dot" only after an @.
_WORDED = re.compile(rf"(?<=[A-Za-z0-9_%+-])(?P<at>[ ](?:{_any(AT_WORDS)})[ ]|[ ]?@[ ]?)(?P<host>[A-Za-z0-9-]++)(?P<dots>(?:(?:[ ](?:{_any(DOT_WORDS)})[ ]|\.)[A-Za-z0-9-]++)*[ ](?:{_any(DOT_WORDS)})[ ][A-Za-z][A-Za-z0-9-]*)", re.IGNORECASE)
_DOT = re.compile(rf"[ ](?:{_any(DOT_WORDS)})[ ]", re.IGNORECASE)
#: The name before an @, of 64 characters at most, may have dots in words too.
_LOCAL = re.compile(rf"(?<![A-Za-z0-9_%+-])[A-Za-z0-9_%+-]++(?:[ ](?:{_any(DOT_WORDS)})[ ][A-Za-z0-9_%+-]++){{1,31}}+(?=@[A-Za-z0-9])", re.IGNORECASE)
_DIGIT_DOTS = re.compile(rf"(?<=[0-9])[ ](?:{_any(DOT_WORDS)})[ ](?=[0-9])", re.IGNORECASE)

_ADDRESS_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, int]  # kind, start, end


def emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _ADDRESS_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        last = at + 1
        if domain:
            last = domain.end()
            yield start, last
        at = text.find("@", last)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts, start = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(x := y.lstrip("0")) <= 3 and int(x or "0") <= 255 for y in four):
                yield start, end
            start = end + 1


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(twice)) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()


def detect(text: str) -> list[Span]:
    """(kind, start, end) by kind, then start; matches of a kind don't overlap, and one that
    fails its check is dropped, not tried again."""
    out: list[Span] = []
    for kind, (sign, find) in enumerate((("@", emails), (".", addresses), ("", cards), ("+", phones))):
        if sign in text:
            out += [(kind, *x) for x in find(text)]
    return out


class Step:
    """What a transducer did: edits (start, end, replacement) of a text, in order."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        pieces, at, self.starts, self.edits, shift = [], 0, [], [], 0
        for s, e, new in edits:
            pieces += [text[at:s], new]
            self.starts.append(s + shift)
            shift += len(new) - (e - s)
            self.edits.append((s, e, len(new), shift))
            at = e
        self.text = "".join([*pieces, text[at:]])

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The span of the text before this step that became this one; parts of a replacement
        stand for all that was replaced."""
        return self._source(start, True), self._source(end - 1, False) if end > start else self._source(start, True)

    def _source(self, i: int, first: bool) -> int:
        k = bisect_right(self.starts, i) - 1
        if k < 0:
            return i if first else i + 1
        s, e, size, shift = self.edits[k]
        if i < self.starts[k] + size:
            return s if first else e
        return i - shift if first else i - shift + 1


@cache
def _folded(c: str) -> str:
    """The ASCII character that c stands for, or c."""
    if c in LOOK_ALIKE:
        return LOOK_ALIKE[c]
    if c in HYPHENS or c in DOTS:
        return "-" if c in HYPHENS else "."
    plain = unicodedata.normalize("NFKC", c)
    if len(plain) == 1 and " " <= plain <= "~" and not unicodedata.decomposition(c).startswith(("<super>", "<sub>")):
        return plain
    return str(d) if (d := unicodedata.decimal(c, None)) is not None else c


#: Letters with marks of Latin scripts, which fold to nothing else, need no look.
_FOLDABLE = re.compile("[^\x00-\x7fÀ-İĲ-ſ]")


def fold(text: str) -> Step | None:
    """Look-alikes and forms of ASCII characters, and invisible ones out."""
    edits = []
    for m in _FOLDABLE.finditer(text) if not text.isascii() else ():
        c = m.group()
        new = "" if c in INVISIBLE else _folded(c)
        if new != c:
            edits.append((m.start(), m.end(), new))
    return Step(text, edits) if edits else None


def references(text: str) -> Step | None:
    """Numeric and some named character references of ASCII characters."""
    edits = []
    for m in _REFERENCE.finditer(text) if "&" in text else ():
        code = int(m["ten"]) if m["ten"] else int(m["hex"], 16) if m["hex"] else ord(_NAMED[m["name"]])
        if 32 <= code < 127:
            edits.append((*m.span(), chr(code)))
    return Step(text, edits) if edits else None


def spelled(text: str) -> tuple[Step | None, list[tuple[int, int, int]]]:
    """Runs of SPELLED_RUN and more digits, at least half of them words, as digits; and where
    those runs are in this text, with their numbers of digits."""
    edits, found = [], []
    for m in _SPELLED.finditer(text) if _HINT.search(text) else ():
        own, gaps, digits, words, dots = [], [], 0, 0, 0
        at = m.start()
        if m["plus"]:
            at = m.end("plus") + 1
            own.append((m.start(), at, "+"))
        elif m["sign"]:
            at = m.end("sign") + (text[m.end("sign")] == " ")
            own += [(m.end("sign"), at, "")] if at > m.end("sign") else []
        for x in _PART.finditer(text, at, m.end()):
            if x["many"] or x["word"]:
                n = TIMES[x["times"].lower()] if x["many"] else 1
                own.append((*x.span(), DIGIT_OF[(x["many"] or x["word"]).lower()] * n))
                digits, words = digits + n, words + n
            elif x["digit"]:
                digits += 1
            elif x["dot"]:
                own.append((*x.span(), "."))
                dots += 1
            else:
                gaps.append(x)
        if digits >= SPELLED_RUN and 2 * words >= digits:
            # Parts of an address have no gaps; in other numbers a gap is one sign.
            own += [(*x.span(), "" if dots else " ") for x in gaps if dots or x["gap"] not in " -"]
            found.append((*m.span(), digits))
            edits += sorted(own)
    return (Step(text, edits) if edits else None), found


def signs(text: str) -> Step | None:
    """"at" and "dot" in brackets, then in words."""
    edits = [(*m.span(), "@" if m["at"] else ".") for m in _BRACKETED.finditer(text)] if re.search(r"[\[({<]", text) else []
    return Step(text, edits) if edits else None


def worded(text: str) -> Step | None:
    edits = []
    for m in _WORDED.finditer(text):
        if m["at"] != "@":
            edits.append((*m.span("at"), "@"))
        edits += [(*x.span(), ".") for x in _DOT.finditer(text, m.start("dots"), m.end("dots"))]
    taken = {x[0] for x in edits}
    edits += [(*m.span(), ".") for m in _DIGIT_DOTS.finditer(text) if m.start() not in taken]
    return Step(text, sorted(edits)) if edits else None


def local_names(text: str) -> Step | None:
    edits = [(*x.span(), ".") for m in _LOCAL.finditer(text) for x in _DOT.finditer(text, *m.span())] if "@" in text else []
    return Step(text, edits) if edits else None


def deobfuscated(text: str) -> list[Span]:
    """Spans of the plain form of a text, in places of the text itself."""
    steps: list[Step] = []
    runs: list[tuple[int, int, int]] = []

    def home(start: int, end: int) -> tuple[int, int]:
        for step in reversed(steps):
            start, end = step.back(start, end)
        return start, end

    now = text
    for transducer in (fold, references, spelled, signs, worded, local_names):
        step = transducer(now)
        if transducer is spelled:
            step, found = step
            runs = [(*home(s, e), n) for s, e, n in found]
        if step is not None:
            steps.append(step)
            now = step.text
    if not steps:
        return []
    spans = [(kind, *home(s, e)) for kind, s, e in detect(now)]
    if runs:
        # Spelled digits are a phone number also without a +, if they are nothing else.
        placed = sorted((s, e) for _, s, e in spans)
        furthest = list(accumulate((e for _, e in placed), max))
        for s, e, n in runs:
            before = bisect_left(placed, (e, 0))
            if 8 <= n <= 15 and not (before and furthest[before - 1] > s):
                spans.append((3, s, e))
    return spans


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(spans of the text itself, all spans), by kind, then start and end."""
    base = detect(text)
    more = deobfuscated(text)
    if not more:
        return base, base
    around: list[Span] = sorted(base)
    firsts = [x[:2] for x in around]

    def held(x: Span) -> bool:
        k = bisect_right(firsts, x[:2]) - 1  # spans of a kind don't overlap
        return k >= 0 and around[k][0] == x[0] and x[2] <= around[k][2]

    return base, sorted({*base, *(x for x in more if not held(x))})


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (kind, start, end, base, found) by kind, then start. Places
    are code points; found is the text of the span; base says that the source text itself has
    it. A null text is empty; rows are judged one by one, so ids may be null or repeat. An
    empty table gives no rows; other columns are not used, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, flat = [0], ([], [], [], [], [])
            for t in b.column(1):
                text = t.as_py()
                base, every = find(text)
                plain = set(base)
                for x in every:
                    k, s, e = x
                    for column, value in zip(flat, (KINDS[k], s, e, x in plain, text[s:e]), strict=True):
                        column.append(value)
                ends.append(len(flat[0]))
            fields = (("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("found", pa.string()))
            spans = pa.StructArray.from_arrays([pa.array(x, k) for x, (_, k) in zip(flat, fields, strict=True)], [n for n, _ in fields])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)], ["doc_id", "spans"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean,found:string>>")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind> and base_sha256 of the spans of the source text, and all spans, as
    kind:start:end by kind, then start. See scan() for odd rows."""
    base = F.filter("spans", lambda x: x["base"])
    say = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.expr(f"size(filter(spans, x -> x.base AND x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    return scan(docs).select("doc_id", *counts, F.sha2(say(base), 256).alias("base_sha256"), say(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs, with its columns, in which each span is its kind in angle brackets; spans that
    overlap are one, of the kind that comes first. Null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(at).to_pylist():
                pieces, done = [], 0
                for s, k, e in sorted((s, k, e) for k, s, e in find(t or "")[1]):
                    if s >= done:
                        pieces += [t[done:s], f"<{KINDS[k]}>"]
                    done = max(done, e)
                out.append(None if t is None else "".join([*pieces, t[done:]]))
            yield b.set_column(at, b.schema.names[at], pa.array(out, pa.string()))

    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    return docs.mapInArrow(run, docs.schema)
