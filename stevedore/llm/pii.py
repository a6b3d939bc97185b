"""Personal data in text, also where it is disguised: offset-preserving deobfuscation.

Each transducer is a list of edits (source range -> replacement) found by one regular expression. It
rewrites the text and keeps the edits, so that a range of the result maps back to source
characters. The chain is: look-alike characters, bracketed or spelled at and dot, spelled digits,
letters that stand for digits. The detectors run on the source (base spans) and on the rewritten
text; a match there that touches an edit is mapped back and added.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stevedore.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, (end := m.end())
        at = text.find("@", max(at + 1, end))


def ips(text: str) -> Iterator[Span]:
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        start, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):  # leftmost, without overlap: each four numbers in turn
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in four):
                yield start, end
            start = end + 1


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _DIGITS.findall(m[0])) <= 19:
            doubled = [int(d) if i % 2 == 0 else 2 * int(d) - 9 * (d > "4") for i, d in enumerate(reversed(digits))]
            if sum(doubled) % 10 == 0:
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.findall(m[0])) <= 15:
            yield m.span()


DETECTORS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))

# Letters of other scripts that look like Latin ones.
_LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅαοιρνυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwABEKMHOPCTYXIJSaoipvukABEZHIKMNOPTYX", strict=True))
_INVISIBLE = "­​‌‍⁠﻿"
_MARKS = {" ": " ", " ": " ", "　": " ", "−": "-", "。": ".", "․": "."} | {chr(c): " " for c in range(0x2000, 0x200B)} | {chr(c): "-" for c in range(0x2010, 0x2016)}


def _plain(c: str) -> str | None:
    """The ASCII character (or nothing) that ``c`` stands for; None if it is no disguise."""
    if c in _INVISIBLE:
        return ""
    if found := _LOOKALIKES.get(c) or _MARKS.get(c):
        return found
    if (digit := unicodedata.decimal(c, None)) is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and " " < folded < "\x7f" and unicodedata.category(c) not in ("No", "Lm") else None


#: Blocks that can hold disguises, kept out of the way of ordinary Latin letters.
_STRANGE = re.compile("[ ­Ͱ-ԯ٠-٩۰-۹०-९​-‍ - ‐-―․ ⁠℀-⅏−　。﹐-﹯﻿！-～\U0001d400-\U0001d7ff]")

_OPEN, _CLOSE = r"\s{0,3}[(\[{<]\s{0,3}", r"\s{0,3}[)\]}>]\s{0,3}"
_AT_WORD, _DOT_WORD = "at|arobase|arroba", "dot|punkt|punto|point"
_LABEL = r"[A-Za-z0-9-]+"
# Endings of domain names that a dot between spaces may stand before.
_ENDING = "com|org|net|edu|gov|info|io|co|de|fr|es|uk|eu"
_SPELLED_DOT = rf"(?:{_OPEN}(?:{_DOT_WORD}|\.){_CLOSE}|\s{{1,2}}\.\s{{1,2}}(?=(?:{_ENDING})\b)|\s{{1,3}}(?:{_DOT_WORD})\s{{1,3}}|[_-](?:{_DOT_WORD})[_-])"
_ANY_DOT = rf"(?:{_SPELLED_DOT}|\.)"
#: Between a name and a domain; a bare "at" counts only in capitals or before a domain with a spelled dot.
_AT = re.compile(
    rf"(?<=[A-Za-z0-9._%+-])(?:{_OPEN}(?:{_AT_WORD}|@){_CLOSE}|&#64;|%40|\s{{0,3}}@\s{{0,3}}(?={_LABEL}{_ANY_DOT}{_LABEL})|(?:\s{{1,3}}(?:{_AT_WORD})\s{{1,3}}|[_-](?:{_AT_WORD})[_-])(?={_LABEL}(?:\.{_LABEL})*{_SPELLED_DOT}{_LABEL})|\s{{1,3}}(?-i:AT)\s{{1,3}}(?={_LABEL}\.{_LABEL}))(?={_LABEL})",
    re.IGNORECASE | re.ASCII,
)
_DOT = re.compile(rf"(?<=[A-Za-z0-9]){_SPELLED_DOT}(?=[A-Za-z0-9])", re.IGNORECASE | re.ASCII)
_DOMAIN_TAIL = re.compile(rf"{_LABEL}(?:{_ANY_DOT}{_LABEL})+", re.IGNORECASE | re.ASCII)
_FOUR_NUMBERS = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{_ANY_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE | re.ASCII)
_BRACKETED = re.compile(rf"[(\[{{<]\s{{0,3}}(?:{_AT_WORD}|@|{_DOT_WORD}|\.)\s{{0,3}}[)\]}}>]", re.IGNORECASE | re.ASCII)

# Names of the digits from 0 to 9, in English, German, French and Spanish.
_NAMES = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
_DIGIT = {name: str(i) for line in _NAMES for i, name in enumerate(line.split())}
_NAME = "|".join(sorted(_DIGIT, key=lambda n: (-len(n), n)))
_GAP = rf"(?:[\s,.()-]{{1,3}}|\s(?:{_DOT_WORD})\s)"
_SPELLED = re.compile(rf"(?<!\w)(?:plus[\s,-]{{1,3}})?(?:{_NAME}|[0-9]+)(?:{_GAP}(?:{_NAME}|[0-9]+))*{_GAP}(?:{_NAME})(?:{_GAP}(?:{_NAME}|[0-9]+))*(?!\w)|(?<!\w)(?:plus[\s,-]{{1,3}})?(?:{_NAME})(?:{_GAP}(?:{_NAME}|[0-9]+))+(?!\w)", re.IGNORECASE)
#: Words of a run: 2 for names of digits, 1 for spelled dots (and numbers).
_RUN_PART = dict.fromkeys(_DOT_WORD.split("|"), 1) | dict.fromkeys(_DIGIT, 2)
_THREE_NAMES = re.compile(b"\2\1*\2\1*\2")
#: A name of a digit beside a number, with spelled dots between or not.
_NAME_BESIDE = re.compile(b"\2\1|\1\2")
_TOKEN = re.compile(rf"(?:{_NAME})(?!\w)|[0-9]+", re.IGNORECASE)
_WORDS = re.compile(r"\w+")
#: Letters that match i and s where case is ignored, but not in lower case.
_SAME_LETTERS = str.maketrans({"\u0130": "i", "\u0131": "i", "\u017f": "s"})
_PART = re.compile(rf"plus[\s,-]{{1,3}}|(?:{_NAME})(?!\w)|\s(?:{_DOT_WORD})\s|[\s,]{{1,3}}", re.IGNORECASE)

_FAKE = {"O": "0", "o": "0", "I": "1", "l": "1"}
_FAKE_RUN = re.compile(r"(?<![A-Za-z0-9])[0-9OoIl]+(?:[\x20().-]{1,2}[0-9OoIl]+)*(?![A-Za-z0-9])")
_FAKE_BESIDE = re.compile(r"[0-9](?:(?=[\x20().-]{0,2}[OoIl])|(?<=[OoIl].)|(?<=[OoIl][\x20().-].)|(?<=[OoIl][\x20().-]{2}.))")


class Rewritten:
    """A text after edits, with the way back."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        self.edits, out, at, shift = [], [], 0, 0
        for start, end, new in edits:
            out += text[at:start], new
            self.edits.append((start + shift, start + shift + len(new), start, end))
            at, shift = end, shift + len(new) - (end - start)
        self.text = "".join([*out, text[at:]])
        self.starts = [e[0] for e in self.edits]
        self.ends = [e[1] for e in self.edits]

    def touched(self, start: int, end: int) -> bool:
        """Whether an edit lies in the range (one that deleted characters: strictly inside it)."""
        k = bisect_right(self.ends, start)
        while k < len(self.edits) and self.edits[k][0] < end:
            if self.edits[k][1] > start:
                return True
            k += 1
        return False

    def source(self, start: int, end: int) -> Span:
        return self._at(start, 0), self._at(end - 1, 1)

    def _at(self, place: int, side: int) -> int:
        """Where the character at ``place`` starts (side 0) or ends (1) in the source."""
        k = bisect_right(self.starts, place) - 1
        while k >= 0 and self.edits[k][1] == self.edits[k][0] and k and self.edits[k][0] > place:
            k -= 1
        if k < 0:
            return place + side
        _, stop, start, end = self.edits[k]
        return (start, end)[side] if place < stop else end + place - stop + side


def _lookalikes(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), new) for m in _STRANGE.finditer(text) if (new := _plain(m[0])) is not None]


def _at_and_dot(text: str) -> list[tuple[int, int, str]]:
    """An at counts where a domain follows; spelled dots count after an at, in that domain, in the name
    before it, and between four numbers."""
    low = text.lower()
    if not (any(w in low for w in (*_DOT_WORD.split("|"), "&#64;", "%40", " @", "@ ")) or " AT " in text or _BRACKETED.search(text)):
        return []
    edits = [(m.start(), m.end(), "@") for m in _AT.finditer(text)]
    began = {end: start for start, end, _ in edits}
    places = sorted([e[1] for e in edits] + [m.end() for m in re.finditer("@", text)])
    done = 0
    for place in places:
        if place >= done and (m := _DOMAIN_TAIL.match(text, place)):
            edits += [(d.start(), d.end(), ".") for d in _DOT.finditer(text, place, m.end()) if d.end() <= m.end()]
            done = m.end()
    for k in range(len(places)):  # spelled dots in the name before the at
        start = began.get(places[k], places[k] - 1)
        if m := re.search(rf"(?:{_LABEL}{_SPELLED_DOT})+[A-Za-z0-9._%+-]+$", text[max(0, start - 80) : start], re.IGNORECASE | re.ASCII):
            base = max(0, start - 80) + m.start()
            edits += [(base + d.start(), base + d.end(), ".") for d in _DOT.finditer(m[0])]
    for m in _FOUR_NUMBERS.finditer(text):
        edits += [(d.start(), d.end(), ".") for d in _DOT.finditer(text, m.start(), m.end()) if d.end() <= m.end()]
    out: list[tuple[int, int, str]] = []
    for edit in sorted(set(edits)):
        if not out or edit[0] >= out[-1][1]:
            out.append(edit)
    return out


def _few_spelled(text: str, run: re.Match[str]) -> bool:
    """Whether the digits are a phone number or a card with the spelled ones, and not before the first of them
    (a name may stand beside a whole number as an ordinary word)."""
    tokens = _TOKEN.findall(run[0])
    digits = "".join(_DIGIT.get(t.lower(), t) for t in tokens)
    before = "".join(takewhile(str.isdecimal, tokens))
    if run[0][:4].lower() == "plus" or text[run.start() - 1 : run.start()] == "+":
        return len(before) < 10 <= len(digits) <= 15
    return any(cards(digits)) and not any(cards(before))


def _spelled_digits(text: str) -> list[tuple[int, int, str]]:
    """Runs with three spelled digits or more, real digits among them or not: white space and commas
    between them go, a spelled dot is a dot. Fewer among real digits count in a run that
    with them has the digits of a phone number (after a plus) or of a card."""
    low = (text if text.isascii() else text.translate(_SAME_LETTERS)).lower()
    # Each part of a run is a whole word, so this holds wherever a run counts.
    parts_of_runs = bytes([_RUN_PART.get(w) or w.isdecimal() for w in _WORDS.findall(low)])
    if not (_THREE_NAMES.search(parts_of_runs) or _NAME_BESIDE.search(parts_of_runs)):
        return []
    edits = []
    for run in _SPELLED.finditer(text):
        parts = list(_PART.finditer(text, run.start(), run.end()))
        names = [p for p in parts if p[0].lower() in _DIGIT]
        if len(names) < 3 and not (names and _few_spelled(text, run)):
            continue
        for p in parts:
            word = p[0].lower()
            new = _DIGIT.get(word) or ("+" if word.startswith("plus") else "." if word.strip() in _DOT_WORD.split("|") else "")
            beside = text[p.start() - 1 : p.start()].isdigit() and text[p.end() : p.end() + 1].isdigit()
            edits.append((p.start(), p.end(), " " if new == "" and beside else new))
    return edits


def _letters_for_digits(text: str) -> list[tuple[int, int, str]]:
    """O, o, I and l in numbers of four real digits or more, no fewer than the letters."""
    if not _FAKE_BESIDE.search(text):  # in each run that counts, a letter is beside a digit
        return []
    edits = []
    for run in _FAKE_RUN.finditer(text):
        fakes = [m.start() for m in re.finditer("[OoIl]", run[0])]
        real = len(_DIGITS.findall(run[0]))
        if fakes and real >= 4 and real >= len(fakes):
            edits += [(run.start() + i, run.start() + i + 1, _FAKE[run[0][i]]) for i in fakes]
    return edits


TRANSDUCERS = (_lookalikes, _at_and_dot, _spelled_digits, _letters_for_digits)


def find(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind's place in KINDS, end, is base), sorted."""
    base = {(s, k, e) for k, kind in enumerate(KINDS) for s, e in DETECTORS[kind](text)}
    chain: list[Rewritten] = []
    now = text
    for transducer in TRANSDUCERS:
        if edits := transducer(now):
            chain.append(Rewritten(now, edits))
            now = chain[-1].text
    added = set()
    if chain:
        for k, kind in enumerate(KINDS):
            for s, e in DETECTORS[kind](now):
                edited = False
                for step in reversed(chain):
                    edited |= step.touched(s, e)
                    s, e = step.source(s, e)
                if edited and (s, k, e) not in base:
                    added.add((s, k, e))
    return sorted([(s, k, e, True) for s, k, e in base] + [(s, k, e, False) for s, k, e in added])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def with_spans(docs: DataFrame, *, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """Append the personal data found in each whole text: array of (kind, start, end, base), sorted by
    start, then kind as in KINDS; code points, end exclusive. ``base`` is false for those found by
    deobfuscation. Null and empty texts have none. A column named ``spans`` must not exist (ValueError).
    No shuffle; rows equal in text get equal spans.
    """
    if spans.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {spans} exists")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in find(t)] if t else [] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _ARROW_SPANS)], names=[*batch.schema.names, spans])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(spans, SPANS)]))


def mask(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The same rows and columns with each span of personal data replaced by ``[KIND]``; overlapping
    spans become one, named by the first. ``n_chars``, where there is one, follows the new text.
    Null texts stay null."""
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = []
            for t in batch.column(text).to_pylist():
                if t and (found := find(t)):
                    out, at = [], 0
                    for s, k, e, _ in found:
                        if s >= at:
                            out += t[at:s], f"[{KINDS[k].upper()}]"
                        at = max(at, e)
                    t = "".join([*out, t[at:]])
                texts.append(t)
            columns = dict(zip(names, batch.columns, strict=True)) | {text: pa.array(texts, batch.schema.field(text).type)}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) if t is not None else n for t, n in zip(texts, columns["n_chars"].to_pylist(), strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return docs.mapInArrow(run, schema)


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and the list of all spans."""
    found = with_spans(docs.select(doc_id, text), text=text)
    base = F.filter("pii_spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select(doc_id, *counts, F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("pii_spans")).alias("spans"))
