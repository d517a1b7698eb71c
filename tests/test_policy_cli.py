import json

import pytest

from tests.test_packages import package, record, write
from trussline.__main__ import main
from trussline.operators import diff, policy
from trussline.sources import packages


def document(**more):
    return {"profile": "p", "policy_id": "site", "policy_version": "1.0.0", "evaluation_time": "2024-01-05T00:00:00Z", "checks": [], "waivers": []} | more


def check(kind, configuration, name="c1", mode="fail"):
    return {"check_id": name, "kind": kind, "severity": "error", "failure_mode": mode, "configuration": configuration}


MINIMUM = check("capability.minimum", {"capabilities": {"mesh": "full", "plan": "opaque"}})


@pytest.mark.parametrize(
    "change",
    [
        {"policy_id": "?"},
        {"policy_version": "1"},
        {"evaluation_time": "2024-01-05"},
        {"checks": [MINIMUM, MINIMUM]},
        {"checks": [check("other", {})]},
        {"checks": [check("loss.maximum", {"overall_max": True})]},
        {"checks": [check("value_state.action", {"record_types": ["entity"], "actions": {"unknown": "fail"}, "field_path": "v"})]},
        {"checks": [MINIMUM], "waivers": [{"waiver_id": "w", "check_id": "c2", "finding_fingerprint": "0", "issued_at": "2024-01-01T00:00:00Z", "expires_at": "2024-02-01T00:00:00Z"}]},
        {"checks": [MINIMUM], "waivers": [{"waiver_id": "w", "check_id": "c1", "finding_fingerprint": "0", "issued_at": "2024-02-01T00:00:00Z", "expires_at": "2024-02-01T00:00:00Z"}]},
    ],
)
def test_bad_policies(change):
    with pytest.raises(policy.PolicyError):
        policy.load_policy(json.dumps(document(**change)))


def test_policy_text():
    with pytest.raises(policy.PolicyError):
        policy.load_policy('{"policy_id":"a","policy_id":"b"}')
    one = policy.load_policy(json.dumps(document(checks=[MINIMUM])))
    assert one.digest == policy.load_policy(json.dumps(document(checks=[MINIMUM]), sort_keys=True, indent=1)).digest


@pytest.fixture
def stores(tmp_path):
    import hashlib

    from trussline.model import RECORD_FILES

    def build(root, name, diagnostics, **manifest):
        base = package(name)
        base["diagnostics/diagnostics.jsonl"] = ("\n".join(diagnostics) + "\n").encode()
        base["model/entities.jsonl"] = (record("e1", "entity", v={"state": "unknown", "reason_code": "x"}) + "\n" + record("e2", "entity") + "\n").encode()
        head = json.loads(base["manifest.json"]) | manifest
        for a in head["artifacts"]:
            a["sha256"], a["bytes"] = hashlib.sha256(base[a["path"]]).hexdigest(), len(base[a["path"]])
        lines = sorted(f"{a['path']}\0{a['sha256']}\0{a['bytes']}\n".encode() for a in head["artifacts"])
        head["logical_digest"] = hashlib.sha256(b"".join(lines)).hexdigest()
        base["manifest.json"] = json.dumps(head).encode()
        write(root, name, base)
        assert set(RECORD_FILES) < set(base)

    noisy = [record(f"d{k}", "diagnostic", code="LOST", severity="warning", affected_count=k) for k in range(3)]
    build(tmp_path / "now", "a", noisy, loss_summary=["LOST"])
    build(tmp_path / "now", "b", [record("d0", "diagnostic", code="OK", severity="info")], capabilities={"mesh": "full", "plan": "partial"})
    build(tmp_path / "was", "a", noisy, capabilities={"mesh": "full", "plan": "full"})
    build(tmp_path / "was", "b", [record("d0", "diagnostic", code="OLD", severity="info")], capabilities={"mesh": "full", "plan": "partial"})
    return tmp_path


def test_evaluation(spark, stores):
    files, was = packages.read_directories(spark, str(stores / "now")), packages.read_directories(spark, str(stores / "was"))
    actions = dict.fromkeys(("unknown", "not_applicable", "conflicted", "explicit_null", "unsupported"), "requires_review")
    checks = [
        MINIMUM,
        check("loss.maximum", {"overall_max": 2, "reason_code_maxima": {"LOST": 9}}, "c2"),
        check("value_state.action", {"record_types": ["entity"], "actions": actions, "field_path": "v"}, "c3", "requires_review"),
        check("diagnostic.maximum", {"threshold": "warning", "max_count": 2}, "c4"),
        check("diff.regression", {"categories": dict.fromkeys(diff.CATEGORIES, "allow") | {"changed_records": "requires_review", "capability_regressions": "fail"}}, "c5"),
    ]
    loaded = policy.load_policy(json.dumps(document(checks=checks)))
    verdicts, statuses, findings = policy.evaluate(spark, loaded, files, was)
    assert sorted(map(tuple, verdicts.collect())) == [("a", "fail", 1), ("b", "requires_review", 1)]
    assert {(r.package_id, r.check_id): r.status for r in statuses.collect()} == {
        ("a", "c1"): "fail", ("a", "c2"): "fail", ("a", "c3"): "requires_review", ("a", "c4"): "fail", ("a", "c5"): "fail",
        ("b", "c1"): "pass", ("b", "c2"): "pass", ("b", "c3"): "requires_review", ("b", "c4"): "pass", ("b", "c5"): "requires_review",
    }
    got = {(r.package_id, r.check_id, r.code): r for r in findings.collect()}
    assert got["a", "c5", "DIFF_CAPABILITY_REGRESSIONS"].observed_state == "full->missing"
    waiver = {"waiver_id": "w", "check_id": "c1", "finding_fingerprint": got["a", "c1", "CAPABILITY_MISSING"].fingerprint, "reason": "r", "approved_by": "x", "issued_at": "2024-01-01T00:00:00Z", "expires_at": "2024-02-01T00:00:00Z"}
    one = policy.load_policy(json.dumps(document(checks=[MINIMUM], waivers=[waiver])))
    verdicts, statuses, _ = policy.evaluate(spark, one, files)
    assert {r.package_id: (r.outcome, r.exit_code) for r in verdicts.collect()} == {"a": ("requires_review", 1), "b": ("requires_review", 1)}


def test_changes_during_an_evaluation_are_errors(spark, stores):
    now, was = stores / "now", stores / "was"
    read = lambda root: lambda: packages.read_directories(spark, str(root))
    one = policy.load_policy(json.dumps(document(checks=[MINIMUM])))
    still = {r.package_id: r.outcome for r in policy.evaluate_unchanged(spark, one, read(now), read(was))[0].collect()}
    assert still == {r.package_id: r.outcome for r in policy.evaluate(spark, one, read(now)())[0].collect()}
    calls = []

    def read_while_it_changes():
        calls.append(1)
        if len(calls) == 3:
            (was / "b" / "context" / "index.md").write_text("changed")
        return packages.read_directories(spark, str(was))

    verdicts, statuses, findings = policy.evaluate_unchanged(spark, one, read(now), read_while_it_changes)
    assert {r.package_id: (r.outcome, r.exit_code) for r in verdicts.collect()} == {"a": ("fail", 1), "b": ("error", 2)}
    assert {(r.check_id, r.status) for r in statuses.filter("package_id = 'b'").collect()} == {("integrity", "error")}
    assert [(r.package_id, r.code) for r in findings.filter("check_id = 'integrity'").collect()] == [("b", "BASELINE_CHANGED_DURING_EVALUATION")]


def test_commands(spark, stores, capsys):
    now, was = str(stores / "now"), str(stores / "was")
    out = lambda: [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert main(["validate", now]) == 0 and out() == []
    assert main(["info", now]) == 0 and [x["package_id"] for x in out()] == ["a", "b"]
    assert main(["query", now, 'entity.v.state == "unknown"']) == 0 and [x["record_id"] for x in out()] == ["e1", "e1"]
    assert main(["query", now, "entity.v = 1"]) == 2
    capsys.readouterr()
    assert main(["diff", now, now]) == 0 and out() == []
    assert main(["diff", was, now]) == 1 and {(x["package_id"], x["category"]) for x in out()} == {("a", "capability_regressions"), ("a", "loss_changes"), ("b", "changed_records")}
    assert main(["context", now, "--tokens", "400"]) == 0
    rows = out()
    assert rows[0]["path"] == "context/chunk-001.md" and "## `source-1` (source)" in rows[0]["content"] and {x["package_id"] for x in rows} == {"a", "b"}
    path = stores / "policy.json"
    path.write_text(json.dumps(document(checks=[MINIMUM])))
    assert main(["gate", now, str(path)]) == 1 and [x["outcome"] for x in out()] == ["fail", "pass"]
    assert main(["gate", now, str(path), "--annotations"]) == 1 and {x["kind"] for x in out()} == {"summary", "check", "finding"}
    (stores / "now" / "a" / "context" / "index.md").write_text("changed")
    assert main(["info", now]) == 2
