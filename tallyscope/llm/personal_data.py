"""Personal data: e-mail addresses, IP addresses, card and phone numbers, disguised ones included.

Base spans are found in the text as it stands. For disguised ones two transducers rewrite the
text, each keeping for every character it puts out the source characters it stands for:

1. characters: letters and digits of other scripts or styles that look like ASCII ones, wide
   forms, odd spaces, dashes and dots become ASCII; invisible characters vanish;
2. words: spelled digits, "plus", letters that stand for digits inside numbers, and at/dot in
   brackets or as words become what they stand for, where their surroundings fit an address or number.

Identifiers are detected again in the rewritten text, and their spans mapped back to source
characters. A span is added if a rewritten character lies in it and it does not touch a base
span. Every pattern reads a text once, from left to right, whatever it holds.

Null counts as empty text. Positions are code points, ends exclusive. One row out per row in;
ids are not looked at, so null and repeated ids are kept as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.ragged import row_slices
from tallyscope.llm.tables import wider

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")

# Letters that look like ASCII letters (Cyrillic, Greek, Latin).
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ɑ": "a", "ʟ": "l",
}
# Signs that stand for an ASCII sign.
SIGNS = {
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "﹘": "-", "﹣": "-",
    "․": ".", "。": ".", "·": ".", "∙": ".", "⋅": ".", "•": ".", "｡": ".",
    " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", "　": " ",
}
#: Invisible characters.
HIDDEN = "­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤︎️﻿"

# Names of the digits in English, French, German and Spanish.
DIGIT_NAMES = (
    ("zero", "oh", "zéro", "null", "cero"), ("one", "un", "eins", "uno"), ("two", "deux", "zwei", "zwo", "dos"), ("three", "trois", "drei", "tres"),
    ("four", "quatre", "vier", "cuatro"), ("five", "cinq", "fünf", "cinco"), ("six", "sechs", "seis"), ("seven", "sept", "sieben", "siete"),
    ("eight", "huit", "acht", "ocho"), ("nine", "neuf", "neun", "nueve"),
)
_DIGIT_OF = {name: str(d) for d, names in enumerate(DIGIT_NAMES) for name in names}
_TIMES = {"double": 2, "triple": 3}
_SPOKEN = frozenset((*_DIGIT_OF, *_TIMES))
#: Letters that stand for digits inside a number.
_DIGIT_LIKE = {"O": "0", "o": "0", "l": "1", "I": "1", "|": "1"}

_DOT_WORD, _AT_WORD = "dot|punkt|punto|point", "at|arroba|ät"
#: Bare words that go together; other words stand for a sign in brackets only.
_PAIRS = {"at": "dot", "arroba": "punto", "ät": "punkt"}
# Last labels that an address in bare words must have.
_LAST_LABELS = frozenset(
    "com org net edu gov mil int info biz name pro io ai app dev me tv co uk us ca au nz de fr es it nl be ch at se no dk fi pl pt ie eu ru br mx ar in jp cn kr za"
    " example test invalid local".split())

_AT_SIGN = re.compile(r"@((?:[A-Za-z0-9-]++)(?:\.[A-Za-z0-9-]++)++)")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


class Span(NamedTuple):
    kind: int
    start: int
    end: int


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses; the local part is read back from each sign once."""
    free = 0
    for m in _AT_SIGN.finditer(text):
        at = m.start()
        if at < free:
            continue
        start = at
        while start > free and _LOCAL_END.match(text, start - 1):
            start -= 1
        if start < at:
            free = m.end()
            yield start, free


def detect(text: str) -> list[Span]:
    """Base spans by kind, then start."""
    out = []
    if "@" in text:
        out += [Span(0, a, b) for a, b in _emails(text)]
    out += [Span(1, *m.span()) for m in _IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and _luhn(d):
            out.append(Span(2, *m.span()))
    if "+" in text:
        out += [Span(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


# -- transducers -------------------------------------------------------------------------------


class Tape(NamedTuple):
    """A rewritten text; character i stands for source characters start[i]..end[i]-1."""

    text: str
    start: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, text: str) -> Tape:
        at = np.arange(len(text))
        return cls(text, at, at + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Apply (start, end, output) edits in ascending order; overlapping later ones are left out."""
        if not edits:
            return self
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            if a < at:
                continue
            text += [self.text[at:a], new]
            starts += [self.start[at:a], np.full(len(new), self.start[a])]
            ends += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            at = b
        text.append(self.text[at:])
        starts.append(self.start[at:])
        ends.append(self.end[at:])
        return Tape("".join(text), np.concatenate(starts), np.concatenate(ends))


_folds: dict[str, str] = {}


def _fold(c: str) -> str:
    """What a non-ASCII character stands for: an ASCII character, nothing, or itself."""
    got = _folds.get(c)
    if got is None:
        got = LOOKALIKES.get(c) or SIGNS.get(c)
        if got is None and c in HIDDEN:
            got = ""
        if got is None:
            plain = unicodedata.normalize("NFKC", c)
            digit = unicodedata.decimal(c, None)
            if digit is not None:
                got = str(digit)
            elif len(plain) == 1 and plain.isascii():
                got = plain
            else:
                got = LOOKALIKES.get(plain, " " if unicodedata.category(c) == "Zs" else c)
        _folds[c] = got
    return got


def fold_characters(tape: Tape) -> Tape:
    """First transducer."""
    if tape.text.isascii():
        return tape
    odd = {c: _fold(c) for c in set(tape.text) if c > "\x7f"}
    if all(c == n for c, n in odd.items()):
        return tape
    hidden = [c for c, n in odd.items() if not n]
    text = tape.text.translate({ord(c): n for c, n in odd.items() if n and n != c})
    folded = Tape(text, tape.start, tape.end)
    if not hidden:
        return folded
    gone = re.compile("[" + "".join(hidden) + "]++")
    return folded.rewrite([(*m.span(), "") for m in gone.finditer(text)])


_NAMES = "|".join(sorted((*_DIGIT_OF, *_TIMES), key=len, reverse=True))
#: Two or more digit names, or one next to a figure, a plus or a dot word.
_SPELLED = re.compile(rf"\b(?:{_NAMES})\b(?:[\s,/-]{{1,3}}(?:{_NAMES})\b)*", re.I)
_PIECE = re.compile(rf"(?:{_NAMES})", re.I)
_BEFORE = re.compile(rf"(?:[0-9+]|\b(?:plus|{_DOT_WORD})|[\])}}])[\s-]{{1,3}}\Z", re.I)
_AFTER = re.compile(rf"[\s-]{{1,3}}(?:[0-9]|(?:{_DOT_WORD})\b|[\[({{])", re.I)
_PLUS = re.compile(r"\bplus[\s-]{1,3}(?=[0-9(])", re.I)
_MIXED = re.compile(r"(?<![A-Za-z0-9|])(?=[OolI|0-9]*[0-9])(?=[0-9]*[OolI|])[0-9OolI|]{2,64}(?![A-Za-z0-9|])")


def _spelled_edits(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _SPELLED.finditer(text):
        pieces = _PIECE.findall(m.group())
        if len(pieces) == 1 and not (_BEFORE.search(text, max(0, m.start() - 12), m.start()) or _AFTER.match(text, m.end())):
            continue
        out, times = [], 1
        for p in pieces:
            p = p.lower()
            if p in _TIMES:
                times = _TIMES[p]
            else:
                out.append(_DIGIT_OF[p] * times)
                times = 1
        if out:
            yield *m.span(), "".join(out)


def _mixed_edits(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _MIXED.finditer(text):
        yield *m.span(), "".join(_DIGIT_LIKE.get(c, c) for c in m.group())


_OPEN, _CLOSE = r"[\[({<]\s{0,3}", r"\s{0,3}[\])}>]"
_DOT = rf"(?:\s{{0,3}}{_OPEN}(?:{_DOT_WORD}|\.){_CLOSE}\s{{0,3}}|\s{{1,3}}(?:{_DOT_WORD})\s{{1,3}}|_(?:{_DOT_WORD})_|\.)"
_AT = re.compile(rf"\s{{0,3}}(?:(?P<closed>{_OPEN}(?:{_AT_WORD}|a|@){_CLOSE})|(?P<sign>@)|(?<=\s)(?P<word>{_AT_WORD})(?=\s)|(?P<low>(?<=[A-Za-z0-9])_(?:{_AT_WORD})_))\s{{0,3}}", re.I)
_DOMAIN = re.compile(rf"[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+)+", re.I)
_ONE_DOT = re.compile(_DOT, re.I)
_DOT_BEFORE = re.compile(rf"{_DOT}\Z", re.I)
_NUMBER_DOT = re.compile(rf"(?<=[0-9]){_DOT}(?=[0-9])", re.I)
_COMPOUND = re.compile(r"[A-Za-z0-9]+[._+-][A-Za-z0-9]|[A-Za-z]+[0-9]|[0-9]+[A-Za-z]")


def _address_edits(text: str) -> Iterator[tuple[int, int, str]]:
    """At and dot disguises of e-mail addresses."""
    for m in _AT.finditer(text):
        start, sign = m.start(), m.end()
        if not start or not _LOCAL_END.match(text, start - 1):
            continue
        domain = _DOMAIN.match(text, sign)
        if not domain:
            continue
        dots = [(sign + d.start(), sign + d.end()) for d in _ONE_DOT.finditer(domain.group())]
        spelled = any(text[a:b] != "." for a, b in dots)
        plain_sign = m.lastgroup == "sign" and m.end() - m.start() == 1
        left = start
        while left and start - left < 64 and _LOCAL_END.match(text, left - 1):
            left -= 1
        if m.lastgroup == "word":
            # a bare word between plain words says nothing, nor do words that do not go together
            bare = {text[a:b].strip().lower() for a, b in dots if text[a:b].strip().isalpha()}
            if not spelled and not _COMPOUND.search(text, left, start):
                continue
            if bare and (bare != {_PAIRS[m["word"].lower()]} or text[dots[-1][1] : domain.end()].lower() not in _LAST_LABELS):
                continue
        edits = [(a, b, ".") for a, b in dots if text[a:b] != "."]
        if not plain_sign:
            edits.append((start, sign, "@"))
        while left:  # dots of the local part
            dot = _DOT_BEFORE.search(text, max(0, left - 16), left)
            if not dot or text[dot.start() : left] == "." or not dot.start() or not _LOCAL_END.match(text, dot.start() - 1):
                break
            edits.append((dot.start(), left, "."))
            left = dot.start()
            stop = max(0, left - 64)
            while left > stop and _LOCAL_END.match(text, left - 1):
                left -= 1
        yield from sorted(edits)


_BRACKETED = re.compile(rf"[\[({{<]\s{{0,3}}(?:{_AT_WORD}|a|@|{_DOT_WORD}|\.)\s{{0,3}}[\])}}>]")
_SIGN_SPACED = re.compile(r"@\s|(?<=\s)@")
_DIGIT_LETTER = re.compile(r"[0-9][oli|]|(?<=[oli|])[0-9]")
_AT_HOST = re.compile(rf"\b(?:{_AT_WORD})\s{{1,3}}[a-z0-9-]{{1,63}}\.[a-z0-9]")
_TOKENS = re.compile(r"\w+|[+\[({\])}]")
_NUMBER_LIKE = frozenset((*_DIGIT_OF, *_TIMES, *_DOT_WORD.split("|"), "plus", *"+[({])}"))


def _hints(text: str) -> bool:
    """Whether a word could be rewritten: cheap tests, each wider than the patterns it stands for."""
    low = text.lower()
    if any(w in low for w in ("dot", "punkt", "punto", "point_", "plus", "_at_", "_arroba_", "_ät_")):
        return True
    if _DIGIT_LETTER.search(low) or _BRACKETED.search(low) or _AT_HOST.search(low) or ("@" in low and _SIGN_SPACED.search(low)):
        return True
    tokens = _TOKENS.findall(low)
    if _SPOKEN.isdisjoint(tokens):
        return False
    like = lambda t: t in _NUMBER_LIKE or "0" <= t[0] <= "9" or "0" <= t[-1] <= "9"
    return any((x in _SPOKEN and like(y)) or (y in _SPOKEN and like(x)) for x, y in zip(tokens, tokens[1:]))


def unspell_words(tape: Tape) -> Tape:
    """Second transducer: figures first, then their signs, then at and dot."""
    if not _hints(tape.text):
        return tape
    tape = tape.rewrite(list(_spelled_edits(tape.text)))
    tape = tape.rewrite(list(_mixed_edits(tape.text)))
    tape = tape.rewrite([(*m.span(), "+") for m in _PLUS.finditer(tape.text)])
    tape = tape.rewrite([(*m.span(), ".") for m in _NUMBER_DOT.finditer(tape.text) if m.group() != "."])
    return tape.rewrite(sorted(_address_edits(tape.text)))


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans of disguised identifiers, in source characters."""
    if text.isascii() and not _hints(text):
        return []
    tape = unspell_words(fold_characters(Tape.of(text)))
    if tape.text == text:
        return []
    out, taken = [], sorted((s.start, s.end) for s in base)
    for kind, a, b in detect(tape.text):
        source = int(tape.start[a]), int(tape.end[b - 1])
        if text[slice(*source)] == tape.text[a:b]:
            continue
        if kind == 0 and not re.search(r"\.[A-Za-z]{2,24}\Z", tape.text[a:b]):
            continue
        if any(x < source[1] and source[0] < y for x, y in taken):
            continue
        out.append(Span(kind, *source))
        taken.append(source)
    return out


SPAN = "array<struct<kind: string, start: bigint, end: bigint, base: boolean>>"
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find_personal_data(docs: DataFrame, column: str = "text") -> DataFrame:
    """All columns of ``docs`` and spans (kind, start, end, base; by kind as in KINDS, then start) and
    redacted_text, where ``[kind]`` stands in the place of each span. Columns that have these names are replaced.
    """
    rows = docs.drop("spans", "redacted_text")
    names = rows.columns
    schema = wider(rows.schema, f"spans {SPAN}, redacted_text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in row_slices(batches, column):
            spans, texts = [], []
            for text in rb.column(column).to_pylist():
                text = text or ""
                base = detect(text)
                found = sorted([(*s, True) for s in base] + [(*s, False) for s in added_spans(text, base)])
                spans.append([{"kind": KINDS[k], "start": a, "end": b, "base": own} for k, a, b, own in found])
                texts.append(redact(text, found) if found else text)
            cols = [pa.array(spans, _SPAN_ARROW), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([rb.column(n) for n in names] + cols, [*names, "spans", "redacted_text"])

    return rows.mapInArrow(run, schema)


def redact(text: str, spans: list[tuple]) -> str:
    """The text with ``[kind]`` in place of each span; a span that begins inside an earlier one is covered by it."""
    out, at = [], 0
    for kind, a, b, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind]}]"]
        elif b > at:
            out.append(f"[{KINDS[kind]}]")
        at = max(at, b)
    return "".join([*out, text[at:]])


def span_digests(found: DataFrame) -> DataFrame:
    """The digest columns of a ``find_personal_data`` result."""
    listed = lambda cond: f"array_join(transform(filter(spans, s -> {cond}), s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    counts = [f"cast(size(filter(spans, s -> s.base and s.kind = '{k}')) as bigint) as n_{k}" for k in KINDS]
    return found.select(
        "doc_id", *[F.expr(c) for c in counts], F.expr(f"sha2({listed('s.base')}, 256)").alias("base_sha256"), F.expr(listed("true")).alias("spans"),
        F.expr("cast(size(filter(spans, s -> not s.base)) as bigint)").alias("n_added"))
