import hashlib
import json
import unicodedata

from pyspark.sql import functions as F

from trussline.functions import canon


def plain(check_id, code, subject, state, refs):
    n = lambda s: unicodedata.normalize("NFC", s)
    identity = {"check_id": n(check_id), "code": n(code), "subject_id": n(subject), "observed_state": n(state), "evidence_refs": sorted({n(r) for r in refs})}
    return hashlib.sha256((json.dumps(identity, sort_keys=True, ensure_ascii=False, separators=(",", ":")) + "\n").encode()).hexdigest()


ROWS = [
    ("c", "CODE", "plain", "known", ["b", "a", "b"]),
    ("c", "CODE", "vt\x0b us\x1f nul\x00 bs\b ff\f tab\t nl\n cr\r del\x7f", "s", ["a\x01"]),
    ("c", 'q"uote', "back\\slash \\u000b", "s", ["/", "~"]),
    ("c", "CODE", "é é \x1f", "s", ["é", "é", "z", "ê"]),
    ("c", "CODE", "日本 👩‍👩‍👧 ￾", "s", ["￿", "\U00010000", "ẛ̣"]),
    ("c", "CODE", "x", "s", []),
]


def test_fingerprints_of_any_text(spark):
    rows = spark.createDataFrame([(k, *r) for k, r in enumerate(ROWS)], "k int, a string, b string, c string, d string, e array<string>")
    got = {r.k: r.f for r in rows.select("k", canon.fingerprint(*map(F.col, "abcde")).alias("f")).collect()}
    assert got == {k: plain(*r) for k, r in enumerate(ROWS)}


def test_empty_fields_have_none(spark):
    bad = [("", "b", "c", "d", ["e"]), (None, "b", "c", "d", ["e"]), ("a", "b", "c", "d", [""]), ("a", "b", "c", "d", [None]), ("a", "b", "c", "d", None)]
    rows = spark.createDataFrame(bad, "a string, b string, c string, d string, e array<string>")
    assert [r[0] for r in rows.select(canon.fingerprint(*map(F.col, "abcde"))).collect()] == [None] * 5
