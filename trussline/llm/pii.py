"""Personal data in whole texts: exact patterns, and disguised forms found in a normalised copy with kept offsets."""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from bisect import bisect_right
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.llm.common import map_rows

#: Kinds in the order that settles equal starts.
KINDS = ("email", "ip", "card", "phone")

# A digit before the start would have been part of the leftmost match, so the lookbehind only saves failing attempts.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the others."""
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    return found


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def plain_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; matches that fail their check are dropped without a retry."""
    found = _emails(text)
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in in_order(spans))


# Letters of other scripts that look like Latin ones, in the order of the Latin letters beside them.
_LOOKALIKES = {
    "АаВСсЕеНІіЈјКМОоРрЅѕТХхУуԁԛԝһ": "AaBCcEeHIiJjKMOoPpSsTXxYydqwh",
    "ΑΒΕΖΗΙΚΜΝΟοΡΤΥΧνɑɡı": "ABEZHIKMNOoPTYXvagi",
    "․。．｡‐‑‒–−": "....-----",
}
_INVISIBLE = "­​‌‍⁠﻿"
_NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


@cache
def _lookalike_table() -> dict[int, str]:
    """One character to one: look-alikes, digits of all scripts, and compatibility forms of single ASCII characters and spaces."""
    table = {}
    for code in range(128, sys.maxunicode + 1):
        char = chr(code)
        if (digit := unicodedata.decimal(char, None)) is not None:
            table[code] = str(digit)
        elif unicodedata.decomposition(char).startswith("<") and len(plain := unicodedata.normalize("NFKC", char)) == 1 and " " <= plain <= "~":
            table[code] = plain
    return table | {ord(a): b for other, latin in _LOOKALIKES.items() for a, b in zip(other, latin)}


@cache
def _lookalike_pattern() -> re.Pattern[str]:
    codes, ranges = sorted(_lookalike_table()), []
    for code in codes:
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges) + "]")


_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_MARKED_DOT = rf"(?:\s*{_OPEN}\s*(?:dot|\.)\s*{_CLOSE}\s*|&#0*46;|&period;)"
_DOT = rf"(?:{_MARKED_DOT}|\s+dot\s+)"
_AT = rf"(?:\s*{_OPEN}\s*(?:at|@)\s*{_CLOSE}\s*|&#0*64;|&commat;|[ \t]+@[ \t]+)"
_LABEL = r"[A-Za-z0-9-]++"
# Last labels of domains that are no common words.
_LAST_LABELS = "com|org|net|edu|gov|mil|info|biz|io|dev|app|eu|uk|de|fr|es|nl|pl|ru|ch|ca|jp|cn|br|au"
#: A local part, a disguised at, and a domain with plain or disguised dots. Where both "at" and "dot" are bare words, they
#: may be prose: there the last label must be a known one, and the sentence must not go on with another "at" or "dot".
_MAIL = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:(?P<at>{_AT}){_LABEL}(?:(?:\.|{_DOT}){_LABEL})+"
    rf"|(?P<bare>\s+at\s+){_LABEL}(?:(?:\.|\s+dot\s+){_LABEL})*{_MARKED_DOT}{_LABEL}(?:(?:\.|{_DOT}){_LABEL})*"
    rf"|(?P<prose>\s+at\s+)(?:{_LABEL}(?:\.|\s+dot\s+))*?{_LABEL}\s+dot\s+(?:{_LABEL}\.)?(?:{_LAST_LABELS})(?![A-Za-z0-9-])(?!\s+(?:at|dot)\s)"
    rf"|(?P<plain>\s*@\s*){_LABEL}(?:\.{_LABEL})*(?:{_DOT}{_LABEL})+)",
    re.IGNORECASE,
)
#: Single characters with single spaces between.
_SPACED_OUT = re.compile(r"(?<!\S)(?:[A-Za-z0-9@._%+-] ){5,}[A-Za-z0-9@._%+-](?=[\s.,;:!?)\]]|\Z)")
_MAIL_HINT = re.compile(rf"{_OPEN}\s*(?:at|@|dot|\.)\s*{_CLOSE}|\sdot\s|[ \t]@[ \t]|&#0*(?:64|46);|&commat;|&period;", re.IGNORECASE)
#: A word of a local part and the disguised dot behind it.
_LEFT = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+" + _DOT, re.IGNORECASE)
#: Four numbers with disguised dots between, plain ones among them.
_ADDRESS = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\.|{_DOT})[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)
_DOT_ONLY = re.compile(_DOT, re.IGNORECASE)
_VALUES = {word: str(k) for k, word in enumerate(_NUMBERS)} | {"oh": "0"}
_NUMBER = "(?:" + "|".join(_VALUES) + ")"
_TIMES = {"double": 2, "triple": 3}
#: Runs of number words with digits, pluses and dots among them.
_SPELLED = re.compile(
    rf"(?:(?:\bplus\s+|\+\s?)|\b)(?:(?:{_NUMBER}|double|triple|dot|point|[0-9]+)[ \t\n.,\-]+|[0-9.]+(?=[a-z])){{0,8}}?{_NUMBER}(?:(?:[ \t\n.,\-]+|(?<=[0-9])|(?=[0-9]))(?:{_NUMBER}|double|triple|dot|point|[0-9]+)\b)+",
    re.IGNORECASE,
)
_SPELLED_TOKEN = re.compile(rf"plus\s+|\+|double|triple|{_NUMBER}|[\s\-]*\b(?:dot|point)\b[\s\-]*|\s*\.\s*|[0-9]+|[\s,\-]+", re.IGNORECASE)
#: A number word with a digit or a plus beside it.
_BESIDE = re.compile(rf"[0-9+](?:[ \t\n.,\-]|dot|point|double|triple)*{_NUMBER}|{_NUMBER}(?:[ \t\n.,\-]|dot|point|double|triple)*[0-9]", re.IGNORECASE)
_NUMBER_ENDS = [word + end for word in _VALUES for end in " \t\n.,-"]
_INVISIBLE_RUN = re.compile(f"[{_INVISIBLE}]+")


class Edited:
    """A text after a list of replacements, with the way back from its offsets to those of the text before."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        pieces, self.new, self.old, at, length = [], [0], [(0, 0, True)], 0, 0
        for start, end, put in edits:
            if start < at:
                continue
            for piece, low, high, same in ((text[at:start], at, start, True), (put, start, end, False)):
                if piece or low < high:
                    self.new.append(length)
                    self.old.append((low, high, same))
                    pieces.append(piece)
                    length += len(piece)
            at = end
        self.new.append(length)
        self.old.append((at, len(text), True))
        self.text = "".join([*pieces, text[at:]])

    def source(self, start: int, end: int) -> tuple[int, int]:
        """Source range of the characters from ``start`` to before ``end``."""
        k, j = bisect_right(self.new, start) - 1, bisect_right(self.new, end - 1) - 1
        first = self.old[k][0] + (start - self.new[k]) * self.old[k][2]
        last = self.old[j][0] + end - self.new[j] if self.old[j][2] else self.old[j][1]
        return first, last


def _mail_edits(text: str) -> list[tuple[int, int, str]]:
    edits, starts = [], {start for _, start, _ in _emails(text)}
    for m in _MAIL.finditer(text):
        starts.add(m.start())
        name = m.lastgroup
        low, high = m.span(name)
        edits += [(d.start(), d.end(), ".") for d in _DOT_ONLY.finditer(text, m.start(), low)]
        edits.append((low, high, "@"))
        edits += [(d.start(), d.end(), ".") for d in _DOT_ONLY.finditer(text, high, m.end())]
    for m in _ADDRESS.finditer(text):
        edits += [(d.start(), d.end(), ".") for d in _DOT_ONLY.finditer(text, m.start(), m.end())]
    # the words that disguised dots join to a local part, from right to left
    left = {m.end(): m.start() for m in _LEFT.finditer(text)}
    for start in starts:
        while (before := left.pop(start, None)) is not None:
            edits += [(d.start(), d.end(), ".") for d in _DOT_ONLY.finditer(text, before, start)]
            start = before
    return sorted(edits)


def _spaced_edits(text: str) -> list[tuple[int, int, str]]:
    """Takes the spaces out of addresses that are spaced out character by character."""
    edits = []
    for m in _SPACED_OUT.finditer(text):
        for kind, start, end in plain_spans(m[0].replace(" ", "")):
            if kind in ("email", "ip"):
                edits += [(k, k + 1, "") for k in range(m.start() + 2 * start + 1, m.start() + 2 * end - 1, 2)]
    return sorted(edits)


def _spaced_hint(text: str) -> bool:
    return " @ " in text or " . " in text


def _digit_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _SPELLED.finditer(text):
        run, words, times, digits, dots, mixed = [], 0, 1, 0, 0, False
        for t in _SPELLED_TOKEN.finditer(text, m.start(), m.end()):
            word = t[0].strip(" \t\n\r\f\v,-").lower()
            if word in _VALUES:
                run.append((t.start(), t.end(), _VALUES[word] * times))
                words, digits, times = words + 1, digits + times, 1
            elif word in _TIMES:
                run.append((t.start(), t.end(), ""))
                times = _TIMES[word]
            elif word in ("plus", "+"):
                run.append((t.start(), t.end(), "+"))
                mixed = True
            elif word in ("dot", "point", "."):
                run.append((t.start(), t.end(), "."))
                dots += 1
            elif not word:
                run.append((t.start(), t.end(), ""))
            else:
                digits, mixed = digits + len(word), True
        # beside digits or a plus one word will do, where the run is as long as a phone number or has an address's dots
        if words >= 3 or words and mixed and (digits >= 10 or dots >= 3):
            edits += run
    return edits


def _may_spell(text: str) -> bool:
    """False only where no three number words can follow each other (two of them have a separator behind) and none has a digit or a plus beside it."""
    low = text.lower()
    return sum(low.count(x) for x in _NUMBER_ENDS) >= 2 or _BESIDE.search(text) is not None


def normalised(text: str) -> list[Edited]:
    """The stages of the normalising transducer; the last holds the final text, and offsets go back through all."""
    stages = []
    if not text.isascii():
        if _lookalike_pattern().search(text):
            stages.append(Edited(text.translate(_lookalike_table()), []))
        now = stages[-1].text if stages else text
        if hidden := [(m.start(), m.end(), "") for m in _INVISIBLE_RUN.finditer(now)]:
            stages.append(Edited(now, hidden))
    for hint, find in ((_spaced_hint, _spaced_edits), (_may_spell, _digit_edits), (_MAIL_HINT.search, _mail_edits)):
        now = stages[-1].text if stages else text
        if hint(now) and (edits := find(now)):
            stages.append(Edited(now, edits))
    return stages


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(plain spans, spans that only the normalised text shows), in source code points, both in order.

    A span of the normalised text counts as new unless it is equal to or inside a plain span of its kind.
    """
    base = in_order(plain_spans(text))
    stages, new = normalised(text), []
    if stages:
        plain = {kind: [(s, e) for k, s, e in base if k == kind] for kind in KINDS}
        for kind, start, end in plain_spans(stages[-1].text):
            for stage in reversed(stages):
                start, end = stage.source(start, end)
            at = bisect_right(plain[kind], start, key=lambda span: span[0])  # plain spans of a kind share no character
            if not at or plain[kind][at - 1][1] < end:
                new.append((kind, start, end))
    return base, in_order(new)


def redacted(text: str) -> str:
    """The text with each stretch of overlapping spans replaced by the kind of its first in brackets."""
    base, new = find_spans(text)
    out, at = [], 0
    for kind, start, end in in_order(base + new):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts and spans of personal data of every whole text.

    (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): the counts and the digest are those of the
    plain patterns, ``spans`` also has the disguised ones and ``n_added`` counts these. Offsets are code points, ends
    exclusive. Null and empty texts have no spans. Every row gives a row; other columns are ignored.
    """

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in batch.column(1).to_pylist():
                base, new = find_spans(text or "")
                kinds = [s[0] for s in base]
                rows.append([*map(kinds.count, KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + new), len(new)])
            cols = list(zip(*rows)) if rows else [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names)

        return work

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), schema, make)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced and, where there is one, ``n_chars`` counted anew.

    Null texts stay null; the other columns and the number of rows stay as they are.
    """
    at = docs.columns.index("text")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = pa.array([None if t is None else redacted(t) for t in batch.column(at).to_pylist()], pa.string())
            return batch.set_column(at, "text", texts)

        return work

    out = map_rows(docs, docs.schema, make)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
