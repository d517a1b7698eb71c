"""Canonical JSON, equality keys, identifiers and digests."""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from trussline.storage import in_runs


def _alike(value: object) -> object:
    """Values that compare equal become the same: true is 1, 1.0 is 1."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float) and math.isfinite(value) and value.is_integer():
        return int(value)
    if isinstance(value, list):
        return [_alike(x) for x in value]
    if isinstance(value, dict):
        return {k: _alike(v) for k, v in value.items()}
    return value


def key_of(text: str | None) -> str | None:
    """Equality key of a JSON text; null if it is null, no JSON, or holds a NaN (which equals nothing)."""
    if text is None:
        return None
    try:
        value = json.loads(text)
        return json.dumps(_alike(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False) if "NaN" in text or "Infinity" in text else json.dumps(_alike(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return None


@F.pandas_udf(StringType())
def equality_key(texts: pd.Series) -> pd.Series:
    """JSON texts that are deeply equal (key order, 1 and 1.0, true and 1 aside) get equal keys."""
    return texts.map(key_of)


def canonical(text: str | None, depth: int = 32) -> str | None:
    """Sorted, NFC-normalised JSON; null for null, for non-finite numbers, colliding keys and nesting beyond ``depth``."""

    def unique(pairs: list[tuple[str, object]]) -> dict[str, object]:
        out = {unicodedata.normalize("NFC", k): v for k, v in pairs}
        if len(out) != len(pairs):
            raise ValueError("keys collide")
        return out

    def clean(value: object, left: int) -> object:
        if left < 0:
            raise ValueError("nested too deep")
        if isinstance(value, str):
            return unicodedata.normalize("NFC", value)
        if isinstance(value, list):
            return [clean(x, left - 1) for x in value]
        if isinstance(value, dict):
            return {k: clean(v, left - 1) for k, v in value.items()}
        return value

    if text is None:
        return None
    try:
        value = clean(json.loads(text, object_pairs_hook=unique), depth)
        return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    return texts.map(canonical)


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def stable_id(prefix: str, source: Column, key: Column) -> Column:
    """``prefix_`` and 24 hex digits of the SHA-256 of source, NUL and key."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat(source, F.lit("\0"), key), 256), 1, 24))


def ordered_digests(rows: DataFrame, key: str, line: Column, name: str) -> DataFrame:
    """(key, name): SHA-256 over all lines of each key, sorted. Null lines don't count; a key of null lines has the empty digest.

    Lines come to the hash in sorted runs and pass one by one, so a key of any size is a stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []
        digest = hashlib.sha256()
        for batch in batches:
            keys, hexes = [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now != [k]:
                    if now:
                        keys.append(now[0])
                        hexes.append(digest.hexdigest())
                    now, digest = [k], hashlib.sha256()
                if text is not None:
                    digest.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(hexes, pa.string())], [key, name])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array(now, batch.column(0).type), pa.array([digest.hexdigest()])], [key, name])

    kind = rows.schema[key].dataType.simpleString()
    return in_runs(rows.select(key, line.alias("line")), [key], "line").mapInArrow(run, f"{key} {kind}, {name} string")


def inventory_line(path: Column, sha256: Column, size: Column) -> Column:
    return F.concat(path, F.lit("\0"), sha256, F.lit("\0"), size.cast("string"), F.lit("\n"))


def pointer_segment(name: Column) -> Column:
    """A JSON-pointer segment: ``~`` and ``/`` escaped, in this order."""
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def markdown_safe(text: Column) -> Column:
    """Text that neither HTML nor Markdown links can read anything into."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("[", "&#91;"), ("]", "&#93;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.floor((F.octet_length(text) + 3) / 4).cast("long")


def base64url(data: Column) -> Column:
    # the lines that base64 may be cut into are joined again
    return F.translate(F.base64(data), "+/=\r\n", "-_")


# The short escapes of JSON strings; other control characters are \\u00xx in lower case.
_SHORT_ESCAPES = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def json_text(text: Column) -> Column:
    """A string as canonical JSON writes it, in quotes; control characters take the slower way only where there are some."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    full = plain
    for code in range(0x20):
        full = F.replace(full, F.lit(chr(code)), F.lit(_SHORT_ESCAPES.get(chr(code), f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f]"), full).otherwise(plain), F.lit('"'))


def _finding_identity(text: str | None) -> str | None:
    if text is None:
        return None
    value = json.loads(text)
    refs = sorted({unicodedata.normalize("NFC", x) for x in value.pop("evidence_refs")})
    return json.dumps({k: unicodedata.normalize("NFC", v) for k, v in value.items()} | {"evidence_refs": refs}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(StringType())
def _normalised_identity(texts: pd.Series) -> pd.Series:
    return texts.map(_finding_identity)


def fingerprint(check_id: Column, code: Column, subject: Column, state: Column, refs: Column) -> Column:
    """SHA-256 of the canonical identity of a finding. ``refs`` is an array of strings; order and repeats don't count.

    The identity is written by Spark; only texts beyond ASCII are normalised by Python, references before they are sorted.
    An empty or null field, or reference, gives null.
    """
    listed = F.array_sort(F.array_distinct(F.transform(refs, lambda x: x)))
    joined = F.concat(F.lit("["), F.array_join(F.transform(listed, json_text), ","), F.lit("]"))
    parts = {"check_id": json_text(check_id), "code": json_text(code), "evidence_refs": joined, "observed_state": json_text(state), "subject_id": json_text(subject)}
    identity = F.concat(*[x for k, (name, value) in enumerate(parts.items()) for x in (F.lit(f'{"{" if not k else ","}"{name}":'), value)], F.lit("}"))
    filled = lambda x: F.coalesce(F.length(x) > 0, F.lit(False))
    sound = filled(check_id) & filled(code) & filled(subject) & filled(state) & F.forall(refs, filled)
    odd = identity.rlike(r"[^\x00-\x7f]")
    return F.when(sound, F.sha2(F.concat(F.coalesce(_normalised_identity(F.when(odd, identity)), identity), F.lit("\n")), 256))


def sorted_distinct(items: Column) -> Column:
    """An array's elements in order, each once; nulls don't count."""
    return F.array_sort(F.array_distinct(F.array_compact(items)))
