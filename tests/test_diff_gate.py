import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

from trussline.operators import diff, gate, trust


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_diff_is_empty_on_itself_and_symmetric(spark):
    a = spark.createDataFrame([(1, "x", "1"), (1, "y", None), (2, "x", "3")], "p int, k string, c string")
    b = spark.createDataFrame([(1, "x", "2"), (2, "x", "3"), (2, "z", "4")], "p int, k string, c string")
    assert rows(diff.diff_records(a, a, ["p", "k"], "c")) == []
    assert rows(diff.diff_records(a, b, ["p", "k"], "c")) == [(1, "x", "changed"), (1, "y", "removed"), (2, "z", "added")]
    turned = {"added": "removed", "removed": "added", "changed": "changed"}
    assert sorted((p, k, turned[s]) for p, k, s in rows(diff.diff_records(b, a, ["p", "k"], "c"))) == rows(diff.diff_records(a, b, ["p", "k"], "c"))


def test_capability_regressions(spark):
    kind = "p int, capability string, level string"
    a = spark.createDataFrame([(1, "a", "full"), (1, "b", "opaque"), (1, "c", "partial"), (1, "d", "odd")], kind)
    b = spark.createDataFrame([(1, "a", "partial"), (1, "b", "full"), (1, "e", "full")], kind)
    changed = diff.diff_maps(a, b, ["p"], "capability", "level")
    assert rows(changed, "capability") == [("a",), ("b",), ("c",), ("d",), ("e",)]
    assert rows(diff.capability_regressions(changed), "capability") == [("a",), ("c",)]


def findings(spark):
    raw = [("p", "k1", "C", "s1", "x", "fail"), ("p", "k1", "C", "s2", "x", "requires_review"), ("p", "k2", "C", "s3", "x", "error")]
    return gate.with_fingerprints(spark.createDataFrame(raw, "package_id string, check_id string, code string, subject_id string, observed_state string, disposition string"))


def test_waivers_in_any_order(spark):
    found = findings(spark).cache()
    prints = {r.subject_id: r.fingerprint for r in found.collect()}
    assert len(set(prints.values())) == 3
    t = lambda day: dt.datetime(2024, 1, day)
    waivers = [("p", "w1", "k1", prints["s1"], t(1), t(10)), ("p", "w2", "k1", prints["s2"], t(5), t(6)), ("p", "w3", "k2", prints["s3"], t(1), t(9)), ("p", "w4", "k1", "0" * 64, t(1), t(9)), ("p", "w5", "k1", prints["s2"], t(1), t(5))]
    moment = F.lit(t(5))
    answers = set()
    for order in itertools.islice(itertools.permutations(waivers), 0, 120, 40):
        w = spark.createDataFrame(list(order), "package_id string, waiver_id string, check_id string, fingerprint string, issued_at timestamp, expires_at timestamp")
        states = gate.waiver_states(w, found, moment)
        assert rows(states, "waiver_id", "state") == [("w1", "active"), ("w2", "active"), ("w3", "active"), ("w4", "mismatch"), ("w5", "expired")]
        applied = gate.apply_waivers(found, w, moment)
        statuses = gate.check_statuses(applied, states)
        answers.add(str([rows(applied, "subject_id", "disposition", "waiver_id"), rows(statuses)]))
    assert answers == {str([[("s1", "waived", "w1"), ("s2", "waived", "w2"), ("s3", "error", None)], [("p", "k1", "requires_review"), ("p", "k2", "error")]])}


def test_outcomes(spark):
    s = spark.createDataFrame([("a", "c", "waived"), ("b", "c", "fail"), ("b", "d", "pass"), ("c", "c", "error"), ("d", "c", "pass")], "package_id string, check_id string, status string")
    packages = spark.createDataFrame([(x,) for x in "abcde"], "package_id string")
    assert rows(gate.outcomes(s, packages)) == [("a", "requires_review", 1), ("b", "fail", 1), ("c", "error", 2), ("d", "pass", 0), ("e", "pass", 0)]


def test_loss_and_diagnostics(spark):
    diag = spark.createDataFrame([("p", "r1", "A", "error", 3), ("p", "r2", "A", "error", 4), ("p", "r3", "B", "info", -1), ("p", "r4", "", "error", 1), ("p", "r5", "C", "odd", 1)], "package_id string, record_id string, code string, severity string, affected_count long")
    declared = spark.createDataFrame([("p", "A"), ("p", "B"), ("p", "Z")], "package_id string, reason string")
    maxima = spark.createDataFrame([("A", 6)], "reason string, maximum long")
    assert rows(gate.loss_maximum(declared, diag, 6, maxima), "code", "subject_id", "observed_state", "disposition") == [
        ("LOSS_EVIDENCE_INCONSISTENT", "B", "invalid_affected_count", "error"),
        ("LOSS_EVIDENCE_MISSING", "Z", "missing", "fail"),
        ("LOSS_MAXIMUM_EXCEEDED", "loss.total", "7", "fail"),
        ("LOSS_REASON_MAXIMUM_EXCEEDED", "A", "7", "fail"),
    ]
    got = gate.diagnostic_maximum(diag, "error", 1, spark.createDataFrame([("A", 1)], "code string, maximum long"))
    assert [r[0] for r in rows(got, "code")] == ["DIAGNOSTIC_CODE_MAXIMUM_EXCEEDED", "DIAGNOSTIC_EVIDENCE_INVALID", "DIAGNOSTIC_EVIDENCE_INVALID", "DIAGNOSTIC_MAXIMUM_EXCEEDED"]


def test_diff_regression_actions(spark):
    c = spark.createDataFrame([("p", "added_records", "a", "added"), ("p", "removed_records", "b", "removed"), ("p", "odd", "c", "changed")], "package_id string, category string, subject_id string, observed_state string")
    assert rows(gate.diff_regression(c, {"added_records": "allow", "removed_records": "fail"}), "code", "disposition") == [("DIFF_ODD", "error"), ("DIFF_REMOVED_RECORDS", "fail")]


def test_markdown_is_inert(spark):
    v = spark.createDataFrame([("p", "fail", 1)], "package_id string, outcome string, exit_code int")
    lines = [r.line for r in gate.markdown(v, findings(spark)).orderBy("place").collect()]
    assert lines[0].startswith("# Delivery gate") and len(lines) == 4 and all(x.startswith("    {") for x in lines[1:])


def test_key_statuses(spark):
    t = lambda day: dt.datetime(2024, 1, day)
    keys = [("k1", "s", t(1), t(9), "good", None, ["a", "b"]), ("k2", "s", t(6), t(9), "good", None, ["a"]), ("k3", "s", t(1), t(5), "good", None, ["a"]), ("k4", "s", t(1), t(9), "revoked", t(5), ["a"]), ("k5", "s", t(1), t(9), "revoked", t(6), []), ("k6", "x", t(1), t(9), "unknown", None, ["a"]), ("k7", "x", t(1), t(9), "good", None, ["a"])]
    df = spark.createDataFrame(keys, "kid string, subject string, valid_from timestamp, valid_until timestamp, revocation_status string, revoked_at timestamp, scopes array<string>")
    got = trust.evaluate_keys(df, F.lit(t(5)), [], ["s"], ["a"])
    assert rows(got, "kid", "key_status", "trust_status", "authorization_status") == [
        ("k1", "valid", "trusted", "authorized"),
        ("k2", "not_yet_valid", "untrusted", "unauthorized"),
        ("k3", "expired", "untrusted", "unauthorized"),
        ("k4", "revoked", "untrusted", "unauthorized"),
        ("k5", "valid", "trusted", "unauthorized"),
        ("k6", "unknown_status", "untrusted", "unauthorized"),
        ("k7", "valid", "untrusted", "unauthorized"),
    ]


def test_markers_of_random_statuses(spark):
    from trussline.model import STATUSES, worst

    r = random.Random(4)
    data = [(k, r.choice(STATUSES)) for k in range(20) for _ in range(r.randrange(1, 5))]
    got = dict(map(tuple, spark.createDataFrame(data, "k int, s string").groupBy("k").agg(worst(F.col("s"))).collect()))
    assert got == {k: max((s for j, s in data if j == k), key=STATUSES.index) for k in range(20)}
