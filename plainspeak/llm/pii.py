"""Personal data in texts, plain and disguised, with places in the source text.

Plain identifiers are found by one expression a kind. For disguised ones a text passes a chain of
transducers, each of which rewrites some pieces and remembers, for every character it writes, the
source characters it stands for:

1. look-alike letters, digits of other scripts, full-width forms and invisible characters;
2. digits spelled as words, in four languages;
3. "at" and "dot" in brackets or as words, where they stand between the parts of an address.

The same expressions then search the rewritten text, and what they find is mapped back to source
characters. Texts in which no transducer would write anything are searched once only.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

KINDS = ("email", "ip", "card", "phone")

# --- fixed values -------------------------------------------------------------------

#: Letters of other scripts that look like an ASCII one, below the letter they look like.
LOOK_ALIKE = dict(
    zip(
        "аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρα",
        "aeopcyxijshdqwABEKMHOPCTYXIJSABEZHIKMNOPTYXovpa",
        strict=True,
    )
)
INVISIBLE = "­​‌‍⁠﻿"
#: English, German, French, Spanish.
DIGIT_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}

# --- plain identifiers --------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't start within a run of digits: its whole run would have matched, or none of it.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*(?:\.[0-9]+){3}")
_DIGIT = re.compile(r"[0-9]")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, without overlap. The local part of the first usable @ begins as far left as it can,
    so it is enough to look at each @ in turn."""
    found, after, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            found.append((start, domain.end()))
            after = domain.end()
        at = text.find("@", max(at + 1, after))
    return found


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def plain(text: str) -> list[list[tuple[int, int]]]:
    """(start, end) of each identifier, for each of KINDS."""
    emails = _emails(text)
    if not _DIGIT.search(text):
        return [emails, [], [], []]
    ips = [m.span() for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    cards = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NO_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                cards.append(m.span())
    phones = []
    if "+" in text:
        phones = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return [emails, ips, cards, phones]


# --- transducers --------------------------------------------------------------------


class Tape:
    """A text and, for each character, the source characters start..end that it stands for."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text = text
        self.start = np.arange(len(text)) if start is None else start
        self.end = np.arange(1, len(text) + 1) if end is None else end

    def rewrite(self, pieces: list[tuple[int, int, str]]) -> Tape:
        """With the pieces (from, to, instead), in order and without overlap, rewritten."""
        if not pieces:
            return self
        text, start, end, at = [], [], [], 0
        for a, b, instead in pieces:
            text += [self.text[at:a], instead]
            start += [self.start[at:a], np.full(len(instead), self.start[a])]
            end += [self.end[at:a], np.full(len(instead), self.end[b - 1])]
            at = b
        text.append(self.text[at:])
        start.append(self.start[at:])
        end.append(self.end[at:])
        return Tape("".join(text), np.concatenate(start), np.concatenate(end))


def _ascii_of(c: str) -> str:
    """The ASCII characters that a character stands for, or itself."""
    if c in LOOK_ALIKE:
        return LOOK_ALIKE[c]
    if c in INVISIBLE:
        return ""
    if unicodedata.decimal(c, -1) >= 0:
        return str(unicodedata.decimal(c))
    plain_form = unicodedata.normalize("NFKC", c)
    return plain_form if len(plain_form) == 1 and plain_form.isascii() and plain_form.isprintable() else c


_FOREIGN = re.compile(r"[^\x00-\x7f]")


def glyphs(tape: Tape) -> Tape:
    if tape.text.isascii():
        return tape
    known = {c: _ascii_of(c) for c in set(tape.text) if c > "\x7f"}
    return tape.rewrite(
        [(m.start(), m.end(), known[m[0]]) for m in _FOREIGN.finditer(tape.text) if known[m[0]] != m[0]]
    )


_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_GLUE = r"(?:[ \t]*[,-][ \t]*|[ \t]+|\n)"
_DOT_WORD = r"[ \t]+dot[ \t]+"
_TWO_WORDS = re.compile(rf"\b(?:{_WORD}){_GLUE}(?:{_WORD})\b", re.I)
_RUN = re.compile(rf"\b(?:{_WORD}|[0-9]+)\b(?:(?:{_DOT_WORD}|{_GLUE})(?:{_WORD}|[0-9]+)\b)+", re.I)
_TOKEN = re.compile(rf"({_WORD})|([0-9]+)|({_DOT_WORD})|{_GLUE}", re.I)
_PLUS = re.compile(r"\bplus[ \t]+(?=[0-9])", re.I)
_BREAKS = ",-().:;"


def _has_digit_words(words: list[str]) -> bool:
    """Two digit words in a row; ``words``: those of the text, in lower case."""
    if DIGIT_WORDS.keys().isdisjoint(words):
        return False
    at = [i for i, w in enumerate(words) if w in DIGIT_WORDS]
    return any(b - a == 1 for a, b in zip(at, at[1:]))


def spelled_digits(tape: Tape) -> Tape:
    """Digit words in a row become digits, "dot" between them a dot, and what else stands between a digit
    word and its neighbour goes. A run counts if two digit words in it follow each other."""
    pieces = []
    for run in _RUN.finditer(tape.text):
        if not _TWO_WORDS.search(run[0]):
            continue
        tokens = list(_TOKEN.finditer(tape.text, run.start(), run.end()))
        for i, t in enumerate(tokens):
            if t[1]:
                pieces.append((t.start(), t.end(), str(DIGIT_WORDS[t[1].lower()])))
            elif t[3]:
                pieces.append((t.start(), t.end(), "."))
            elif not t[2] and (tokens[i - 1][1] or tokens[i + 1][1]):
                pieces.append((t.start(), t.end(), ""))
    tape = tape.rewrite(pieces)
    return tape.rewrite([(m.start(), m.end(), "+") for m in _PLUS.finditer(tape.text)])


# A run of blanks is tried from its first one only: a text padded with a million of them is read once.
_BLANKS = r"(?<![ \t])[ \t]"
_OPEN, _CLOSE = rf"{_BLANKS}*[\[({{<][ \t]*", r"[ \t]*[\])}>][ \t]*"
_AT = rf"{_OPEN}(?:at|@){_CLOSE}|{_BLANKS}+at[ \t]+|{_BLANKS}*@[ \t]*"
_DOT = rf"{_OPEN}(?:dot|\.){_CLOSE}|{_BLANKS}+dot[ \t]+"
_ADDRESS = re.compile(rf"({_AT})([A-Za-z0-9-]+(?:(?:{_DOT}|\.)[A-Za-z0-9-]+)+)", re.I)
_DOTS = re.compile(_DOT, re.I)
_LOCAL_DOT = re.compile(rf"(?<=[A-Za-z0-9_%+-])(?=({_DOT})[A-Za-z0-9_%+-])", re.I)
_LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]+")
_DOT_DIGITS = re.compile(rf"(?<=[0-9])(?:{_DOT})(?=[0-9])", re.I)
_BRACKETS = re.compile(r"[\[({<][ \t]*(?:at|dot|@|\.)[ \t]*[\])}>]", re.I)


def at_dot(tape: Tape) -> Tape:
    """A bare "at" counts only if a disguised dot follows it: "seen at example.com" is no address."""
    pieces = []
    for m in _ADDRESS.finditer(tape.text):
        dots = list(_DOTS.finditer(tape.text, m.start(2), m.end(2)))
        if m[1].strip(" \t").lower() == "at" and not dots:
            continue
        if m[1] != "@":
            pieces.append((m.start(1), m.end(1), "@"))
        pieces += [(d.start(), d.end(), ".") for d in dots]
    tape = tape.rewrite(pieces)
    text, dots, begins = tape.text, [], set()
    for m in reversed(list(_LOCAL_DOT.finditer(text))):  # "first dot last@": from the @ to the left
        after = _LOCAL_PART.match(text, m.end(1)).end()
        if text[after : after + 1] == "@" or after in begins:
            dots.append((m.start(1), m.end(1), "."))
            begins.add(m.start(1))
    tape = tape.rewrite(dots[::-1])
    return tape.rewrite([(m.start(), m.end(), ".") for m in _DOT_DIGITS.finditer(tape.text)])


def transduced(text: str) -> Tape | None:
    """The text after all transducers, or None if none of them writes anything. The searches before each
    are cheap ones that hold whenever it has something to write."""
    tape = None
    if not text.isascii() and any(c > "\x7f" and _ascii_of(c) != c for c in set(text)):
        tape = glyphs(Tape(text))
    changed = tape is not None
    now = tape.text if changed else text
    low = now.lower()
    for c in _BREAKS:
        low = low.replace(c, " ")
    words = low.split()
    spelled = _has_digit_words(words)
    marked = "dot" in words or " @" in now or "@ " in now or _BRACKETS.search(now) is not None
    if not changed and not spelled and not marked:
        return None
    tape = tape or Tape(text)
    if spelled:
        tape = spelled_digits(tape)
    if marked:
        tape = at_dot(tape)
    return tape


def disguised(text: str, known: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Source (start, end) of identifiers that show after rewriting and aren't part of a known one of their kind."""
    tape = transduced(text)
    if tape is None:
        return [[] for _ in KINDS]
    found = []
    for spans, old in zip(plain(tape.text), known):
        mine = [(int(tape.start[a]), int(tape.end[b - 1])) for a, b in spans]
        begins = [x for x, _ in old]  # in order, without overlap
        found.append([(a, b) for a, b in mine if not (i := bisect.bisect_right(begins, a)) or old[i - 1][1] < b])
    return found


# --- the operator -------------------------------------------------------------------


def _written(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, mine in zip(KINDS, spans) for a, b in mine)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, written = [], [], []
        for value in batch.column("text"):
            text = value.as_py()
            base = plain(text)
            every = [sorted(a + b) for a, b in zip(base, disguised(text, base))]
            counts.append([len(x) for x in base])
            digests.append(hashlib.sha256(_written(base).encode()).hexdigest())
            written.append(_written(every))
        numbers = np.array(counts, np.int64).reshape(-1, len(KINDS))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *[pa.array(numbers[:, i]) for i in range(len(KINDS))], pa.array(digests, pa.string()), pa.array(written, pa.string())],
            names=["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
        )


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_<kind> of the plain identifiers, base_sha256 of their spans,
    and ``spans``: plain and disguised ones as kind:start:end, by kind, then start.

    Places are code points of the whole source text, end exclusive. Null and empty texts have none.
    Rows that repeat an id, or have none, get a row each. An empty table gives an empty result. Other
    columns of ``docs`` are ignored. No shuffle; a task holds one batch of rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    numbers = ", ".join(f"n_{k} bigint" for k in KINDS)
    return rows.mapInArrow(_search, f"id {kind}, {numbers}, base_sha256 string, spans string").withColumnRenamed(
        "id", id_col
    )
