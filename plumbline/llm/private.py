"""Operator 7: personal data in plain and disguised form, with places in the original text.

Plain e-mail addresses, IP addresses, card and phone numbers are found in the text as it is. Then two
transducers rewrite what may be a disguise: the first drops invisible characters, turns look-alike
letters and digits into ASCII, bracketed at and dot into signs and runs of spelled digits into digits;
the second turns "name at host dot tld" and "name @ host.tld" into an address, wherever they stand; "name
at host.tld" only if the name holds a digit or sign as in "jo.do", since "look at example.com" names a
host and no person. Each keeps, for every character it writes,
the source characters it stands for, so matches in the rewritten text map back to the original. A
disguised match that overlaps a plain one of its kind is dropped: the plain one stays.

Null text is empty and holds nothing; a null doc_id is kept; repeated rows give repeated results; an
empty table gives no rows; other columns are not read by `find_private` and kept by `mask_private`.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches, text_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind's place in KINDS, end

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
# a match begins where its digits begin: after a failure there, none begins among them
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

# fixed values: letters that look like Latin ones, and digits as words in four languages
LOOKS = dict(zip(
    "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧονα٠۰",
    "ABESIJKMHOPCTYXaesijopcyxdqwhlABEZHIKMNOPTYXova00",
))
DIGIT_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
AT_WORDS, DOT_WORDS, PLUS_WORDS = "at|arroba", "dot|punkt|punto|point", "plus|más"

INVISIBLE = "­​-‏⁠-⁤﻿"
ODD = re.compile(f"[{INVISIBLE}²³¹Ͱ-ϿЀ-ԯ٠-٩۰-۹⁰-ₜ①-⓿！-～\U0001d400-\U0001d7ff]")
_DIGIT = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + "|[0-9])"
_STEP = rf"(?:[\x20,-]+|[\x20]+(?:{DOT_WORDS})[\x20]+)"
RUN = re.compile(rf"\b(?:(?:{PLUS_WORDS})\x20+)?{_DIGIT}(?:{_STEP}{_DIGIT}){{3,}}\b", re.IGNORECASE)
RUN_PART = re.compile(rf"(?P<plus>{PLUS_WORDS})|(?P<dot>{DOT_WORDS})|(?P<digit>{_DIGIT})", re.IGNORECASE)
BRACKETED = re.compile(
    rf"(?:(?<!\x20)\x20*+)?[\[({{<]\x20*+(?:(?P<at>{AT_WORDS}|@)|(?:{DOT_WORDS}|\.))\x20*[\])}}>]\x20*", re.IGNORECASE
)
_NAME, _PART = "[A-Za-z0-9._%+-]++", "[A-Za-z0-9-]+"
_AT, _DOT, _TOP = rf"\x20+(?:{AT_WORDS})\x20+", rf"\x20+(?:{DOT_WORDS})\x20+", r"[A-Za-z]{2,6}\b"
SPOKEN = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?:"
    rf"{_NAME}{_AT}{_PART}(?:\.{_PART})*{_DOT}(?:{_PART}(?:{_DOT}|\.))*{_TOP}"
    rf"|{_NAME}\x20*@\x20*{_PART}(?:(?:{_DOT}|\.){_PART})*(?:{_DOT}|\.){_TOP}"
    rf"|[A-Za-z](?=[A-Za-z-]*[0-9._%+]){_NAME}(?<!\.){_AT}{_PART}(?:\.{_PART})*\.{_TOP})",
    re.IGNORECASE,
)
# what every match of SPOKEN holds that rewriting changes
MAYBE_SPOKEN = re.compile(
    rf"\x20(?:{AT_WORDS})\x20+{_PART}(?:{_DOT}|\.)|(?:\x20@\x20*|@\x20+){_PART}(?:{_DOT}|\.)|@[A-Za-z0-9.-]+{_DOT}", re.IGNORECASE
)
SPOKEN_PART = re.compile(rf"\x20+(?P<at>{AT_WORDS})\x20+|\x20*(?P<sign>@)\x20*|\x20+(?:{DOT_WORDS})\x20+", re.IGNORECASE)
IN_RUN = frozenset([*DIGIT_WORDS, *"0123456789", *DOT_WORDS.split("|"), *PLUS_WORDS.split("|")])


def luhn(digits: str) -> bool:
    last = digits[::-1]
    return (sum(map(int, last[::2])) + sum(DOUBLED[int(d)] for d in last[1::2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: from each @ back over the characters of a name, not into the match before."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and not LOCAL_END.match(text, start - 1):
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def plain(text: str) -> list[Span]:
    """Spans of all kinds in the text as it is, by start, then kind."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) < 3 or (len(p) == 3 and p <= "255") for p in parts):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


class Rewritten:
    """A text with the source span of each of its characters."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts: array, ends: array):
        self.text, self.starts, self.ends = text, starts, ends

    def rewrite(self, pattern: re.Pattern, parts: Callable[[re.Match], list[tuple[str, int, int]]]) -> Rewritten:
        """Replaces each match by pieces (new text, from, to); all characters of a piece share its source."""
        out, starts, ends, at = [], array("q"), array("q"), 0
        for m in pattern.finditer(self.text):
            for new, a, b in [(self.text[at : m.start()], at, m.start()), *parts(m)]:
                out.append(new)
                if len(new) == b - a:
                    starts += self.starts[a:b]
                    ends += self.ends[a:b]
                else:
                    starts += self.starts[a : a + 1] * len(new)
                    ends += self.ends[b - 1 : b] * len(new)
            at = m.end()
        return Rewritten("".join(out) + self.text[at:], starts + self.starts[at:], ends + self.ends[at:])


def _plain_letter(m: re.Match) -> list[tuple[str, int, int]]:
    c = m.group()
    new = LOOKS.get(c) or unicodedata.normalize("NFKC", c)
    if unicodedata.category(c) == "Cf":
        new = ""
    elif unicodedata.decimal(c, None) is not None:
        new = str(unicodedata.decimal(c))
    return [(new if len(new) < 2 else c, m.start(), m.end())]


def _digits(m: re.Match) -> list[tuple[str, int, int]]:
    found = []
    for p in RUN_PART.finditer(m.group()):
        word = p.group().lower()
        new = "+" if p["plus"] else "." if p["dot"] else word if word.isdigit() else str(DIGIT_WORDS[word])
        found.append((new, m.start() + p.start(), m.start() + p.end()))
    return found


def _sign(m: re.Match) -> list[tuple[str, int, int]]:
    return [("@" if m["at"] else ".", m.start(), m.end())]


def _address(m: re.Match) -> list[tuple[str, int, int]]:
    found, at = [], m.start()
    for p in SPOKEN_PART.finditer(m.group()):
        a, b = m.start() + p.start(), m.start() + p.end()
        found += [(m.string[at:a], at, a), ("@" if p["at"] or p["sign"] else ".", a, b)]
        at = b
    return [*found, (m.string[at : m.end()], at, m.end())]


def _counted(low: str) -> bool:
    """Whether four words in a row could belong to a run of spelled digits."""
    return b"\1\1\1\1" in bytes(map(IN_RUN.__contains__, low.replace("-", " ").replace(",", " ").split()))


def disguised(text: str) -> list[Span]:
    """Spans in the original of what only the rewritten text shows."""
    low = text.lower()
    steps = [
        (ODD, _plain_letter, not text.isascii() and ODD.search(text)),
        (BRACKETED, _sign, ("[" in text or "(" in text or "{" in text or "<" in text) and BRACKETED.search(text)),
        (RUN, _digits, _counted(low) and RUN.search(text)),
    ]
    odd = bool(steps[0][2])
    if not any(wanted for _, _, wanted in steps) and not MAYBE_SPOKEN.search(text):
        return []
    now = Rewritten(text, array("q", range(len(text))), array("q", range(1, len(text) + 1)))
    for pattern, parts, wanted in steps:
        if wanted or odd:
            now = now.rewrite(pattern, parts)
    now = now.rewrite(SPOKEN, _address)
    return [(now.starts[s], kind, now.ends[e - 1]) for s, kind, e in plain(now.text)]


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans: the plain ones and the disguised ones that overlap none of their kind."""
    base = plain(text)
    found = list(base)
    taken = [[(s, e) for s, k, e in base if k == kind] for kind in range(len(KINDS))]
    last = [0] * len(KINDS)  # where the last added span of each kind ends
    for start, kind, end in disguised(text):
        i = bisect_left(taken[kind], (end, 0))  # plain spans of a kind are apart, so only the last before `end` may overlap
        if start >= last[kind] and (i == 0 or taken[kind][i - 1][1] <= start):
            found.append((start, kind, end))
            last[kind] = end
    return base, sorted(found)


def written(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def mask(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for start, kind, end in spans(text)[1]:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def find_private(docs: DataFrame) -> DataFrame:
    """Per document the counts and digest of plain spans, all spans, and how many the method added."""
    kinds = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
    names = [k.split()[0] for k in kinds.split(", ")]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                base, found = spans(text)
                counts = [sum(k == i for _, k, _ in base) for i in range(4)]
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                rows.append((doc_id, *counts, digest, written(found), len(found) - len(base)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).mapInArrow(run, kinds)


def mask_private(docs: DataFrame) -> DataFrame:
    """The documents with all personal data masked in `text`; null stays null."""

    @F.arrow_udf("string")
    def masked(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield pa.array([None if t is None else mask(t) for t in part.to_pylist()], pa.string())

    return docs.withColumn("text", masked("text"))
