"""Gate policies: a control document, read strictly, becomes checks over all packages of a store in one run."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trussline.functions.canon import canonical
from trussline.functions.values import IDENTIFIER, INSTANT, SEMVER
from trussline.model import RECORD_TYPES, SEVERITIES, SUPPORT_LEVELS, VALUE_STATES
from trussline.operators import diff, gate
from trussline.operators.query import at_path
from trussline.sources.packages import inventory, manifests, records
from trussline.sources.scanners import strict_json
from trussline.storage import stored

KINDS = ("capability.minimum", "loss.maximum", "value_state.action", "diagnostic.maximum", "diff.regression")
#: Limits of a policy and of its result; beyond them the run fails instead of cutting.
MAX_BYTES, MAX_CHECKS, MAX_WAIVERS, MAX_FINDINGS = 1 << 20, 256, 1024, 100_000


class PolicyError(ValueError):
    """The document is not a policy."""


@dataclass(frozen=True)
class Policy:
    policy_id: str
    evaluation_time: str
    checks: tuple[dict, ...]
    waivers: tuple[dict, ...]
    digest: str


def _need(holds: bool, what: str) -> None:
    if not holds:
        raise PolicyError(what)


def load_policy(text: str) -> Policy:
    """A policy from JSON text: no repeated keys, known kinds, unique ids, waivers of checks that are there."""
    import json

    _need(len(text.encode()) <= MAX_BYTES, "the policy is too large")
    try:
        doc = strict_json(text)
    except ValueError as error:
        raise PolicyError(str(error)) from error
    _need(isinstance(doc, dict), "the policy is no object")
    _need(bool(re.match(IDENTIFIER, str(doc.get("policy_id", "")))), "policy_id")
    _need(bool(re.match(SEMVER, str(doc.get("policy_version", "")))), "policy_version")
    _need(bool(re.match(INSTANT, str(doc.get("evaluation_time", "")))), "evaluation_time")
    checks, waivers = doc.get("checks", []), doc.get("waivers", [])
    _need(isinstance(checks, list) and len(checks) <= MAX_CHECKS, "checks")
    _need(isinstance(waivers, list) and len(waivers) <= MAX_WAIVERS, "waivers")
    for c in checks:
        _need(isinstance(c, dict) and c.get("kind") in KINDS, "kind of a check")
        _need(bool(re.match(IDENTIFIER, str(c.get("check_id", "")))) and isinstance(c.get("configuration"), dict), "form of a check")
        _need(c.get("failure_mode", "fail") in ("fail", "requires_review"), "failure_mode")
        _check_configuration(c["kind"], c["configuration"])
    ids = [c["check_id"] for c in checks]
    _need(len(set(ids)) == len(ids), "a check_id repeats")
    for w in waivers:
        _need(isinstance(w, dict) and w.get("check_id") in ids, "check of a waiver")
        _need(all(re.match(INSTANT, str(w.get(k, ""))) for k in ("issued_at", "expires_at")) and w["issued_at"] < w["expires_at"], "interval of a waiver")
    names = [w.get("waiver_id") for w in waivers]
    targets = [(w["check_id"], w.get("finding_fingerprint")) for w in waivers]
    _need(len(set(names)) == len(names) and len(set(targets)) == len(targets), "a waiver repeats")
    return Policy(doc["policy_id"], doc["evaluation_time"], tuple(checks), tuple(waivers), hashlib.sha256((canonical(json.dumps(doc)) + "\n").encode()).hexdigest())


def _check_configuration(kind: str, conf: dict) -> None:
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= 0
    actions = lambda d: isinstance(d, dict) and all(v in ("allow", "requires_review", "fail") for v in d.values())
    if kind == "capability.minimum":
        _need(bool(conf.get("capabilities")) and all(v in SUPPORT_LEVELS for v in conf["capabilities"].values()), "capabilities")
    elif kind == "loss.maximum":
        _need(all(whole(x) for x in [conf.get("overall_max", 0), *(conf.get("reason_code_maxima") or {}).values()]), "loss maxima")
    elif kind == "value_state.action":
        _need(set(conf.get("record_types", [])) <= set(RECORD_TYPES) and actions(conf.get("actions")) and set(conf["actions"]) == set(VALUE_STATES[1:]), "value state actions")
        _need("field_path" in conf, "field_path")
    elif kind == "diagnostic.maximum":
        _need(conf.get("threshold") in SEVERITIES and all(whole(x) for x in [conf.get("max_count"), *(conf.get("per_code_maxima") or {}).values()]), "diagnostic maxima")
    else:
        _need(actions(conf.get("categories")) and set(conf["categories"]) == set(diff.CATEGORIES), "categories")


def package_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(package_id, category, subject_id, observed_state) between two stores of packages, by package folder or archive."""
    from trussline.functions.canon import equality_key

    old, new = manifests(before), manifests(after)
    both = old.select("package_id").join(new.select("package_id"), "package_id")
    keyed = lambda files: records(files).join(both, "package_id", "left_semi").select("package_id", "record_id", equality_key("json").alias("content"))
    changed = diff.diff_records(keyed(before), keyed(after), ["package_id", "record_id"], "content")
    parts = [changed.select("package_id", F.concat("status", F.lit("_records")).alias("category"), F.col("record_id").alias("subject_id"), F.col("status").alias("observed_state"))]
    named = lambda m: inventory(m.join(both, "package_id", "left_semi"))
    artifacts = diff.diff_inventories(named(old), named(new), ["package_id"]).filter("is_authoritative")
    parts.append(artifacts.select("package_id", F.lit("artifact_changes"), "path", F.lit("changed")))
    levels = lambda m: m.join(both, "package_id", "left_semi").select("package_id", F.explode("capabilities").alias("capability", "level"))
    worse = diff.capability_regressions(diff.diff_maps(levels(old), levels(new), ["package_id"], "capability", "level"))
    parts.append(worse.select("package_id", F.lit("capability_regressions"), "capability", F.concat("before", F.lit("->"), F.coalesce("after", F.lit("missing")))))
    parts.append(manifest_changes(old, new))
    return reduce(DataFrame.union, parts)


def manifest_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes of losses (their order counts), identity, producer and version between manifests of the same packages."""
    fields = {"loss_summary": "loss_changes", "source_ids": "identity_changes", "source_embedding_policy": "identity_changes", "named": "identity_changes", "producer": "producer_changes", "format_version": "version_changes"}
    # the entries of a map have no order of their own
    plain = lambda m, c: F.array_sort(F.map_entries(c)) if m.schema[c].dataType.typeName() == "map" else F.col(c)
    side = lambda m, prefix: m.select("package_id", *[F.to_json(F.struct(plain(m, c).alias(c))).alias(f"{prefix}{c}") for c in fields])
    pair = side(before, "b_").join(side(after, "a_"), "package_id")
    told = [F.when(~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}")), F.struct(F.lit(category).alias("category"), F.lit(f"manifest.{c}").alias("subject_id"), F.lit("changed").alias("observed_state"))) for c, category in fields.items()]
    return pair.select("package_id", F.inline(F.array_compact(F.array(*told))))


def within_limit(findings: DataFrame, most: int = MAX_FINDINGS) -> DataFrame:
    """``findings`` with those of a package that has more than ``most`` replaced by one error; other packages keep theirs."""
    counts = findings.groupBy("package_id").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    error = gate.with_fingerprints(gate._findings(counts, "limits", "FINDINGS_LIMIT_EXCEEDED", F.lit("findings"), F.col("n"), "error"))
    return findings.join(counts.select("package_id"), "package_id", "left_anti").select(*error.columns).union(error)


def evaluate(spark: SparkSession, policy: Policy, files: DataFrame, baseline: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, check statuses, findings) of all packages of ``files``, valid ones by assumption: validate them first.

    Every check of the policy has a status for every package, ``pass`` where nothing was found. diff.regression needs
    the baseline's files.
    """
    packages, lines = manifests(files), records(files)
    only = packages.select("package_id")
    diagnostics = lines.filter("record_type = 'diagnostic'").withColumn("doc", F.parse_json("json"))
    diagnostics = diagnostics.select("package_id", "record_id", *[F.try_variant_get("doc", f"$.{k}", t).alias(k) for k, t in (("code", "string"), ("severity", "string"), ("affected_count", "long"))])
    table = lambda d, kind: spark.createDataFrame(sorted(d.items()), kind) if d else None
    found = []
    for c in policy.checks:
        conf, mode, name = c["configuration"], c.get("failure_mode", "fail"), c["check_id"]
        if c["kind"] == "capability.minimum":
            levels = packages.select("package_id", F.explode("capabilities").alias("capability", "level"))
            found.append(gate.capability_minimum(levels, conf["capabilities"], only, name, mode))
        elif c["kind"] == "loss.maximum":
            declared = packages.select("package_id", F.explode("loss_summary").alias("reason")).distinct()
            found.append(gate.loss_maximum(declared, diagnostics, conf.get("overall_max"), table(conf.get("reason_code_maxima"), "reason string, maximum long"), name, mode))
        elif c["kind"] == "diagnostic.maximum":
            found.append(gate.diagnostic_maximum(diagnostics, conf["threshold"], conf["max_count"], table(conf.get("per_code_maxima"), "code string, maximum long"), name, mode))
        elif c["kind"] == "value_state.action":
            value = at_path(F.parse_json("json"), tuple(conf["field_path"].split(".")))
            chosen = lines.filter(F.col("record_type").isin(conf["record_types"]))
            states = chosen.select("package_id", F.concat("record_id", F.lit("#" + conf["field_path"])).alias("subject"), value.isNotNull().alias("present"), F.try_variant_get(value, "$.state", "string").alias("state"))
            found.append(gate.value_state_action(states, conf["actions"], name, mode))
        else:
            _need(baseline is not None, "diff.regression needs a baseline")
            found.append(gate.diff_regression(package_changes(baseline, files), conf["categories"], name))
    none = gate._findings(only.limit(0), "", "", F.lit(""), F.lit(""), "")
    findings = gate.with_fingerprints(reduce(DataFrame.union, found, none))
    findings = within_limit(findings)
    fields = ("waiver_id", "check_id", "finding_fingerprint", "issued_at", "expires_at")
    entries = [F.struct(*[F.lit(w[k]).alias(k.removeprefix("finding_")) for k in fields]) for w in policy.waivers]
    each = only.select("package_id", F.inline(F.array(*entries))) if entries else None
    moment = F.to_timestamp(F.lit(policy.evaluation_time))
    if each is not None:
        each = each.withColumns({k: F.to_timestamp(k) for k in ("issued_at", "expires_at")})
        states = gate.waiver_states(each, findings, moment)
        findings = gate.apply_waivers(findings, each, moment)
    else:
        states, findings = None, findings.withColumn("waiver_id", F.lit(None).cast("string"))
    every = only.withColumn("check_id", F.explode(F.array(*[F.lit(c["check_id"]) for c in policy.checks]))) if policy.checks else only.select("package_id", F.lit("none").alias("check_id"))
    told = gate.check_statuses(findings, states)
    statuses = every.join(told, ["package_id", "check_id"], "left").withColumn("status", F.coalesce("status", F.lit("pass")))
    statuses = statuses.unionByName(told.filter("check_id = 'limits'"))
    return gate.outcomes(statuses, only), statuses, findings


def fingerprints_of(files: DataFrame) -> DataFrame:
    """(package_id, digest) of each package: over the paths, sizes and hashes of its files, in order."""
    entry = F.concat_ws("\0", F.coalesce("path", F.lit("")), F.coalesce("sha256", F.lit("")), F.coalesce(F.col("bytes").cast("string"), F.lit("")), F.coalesce("error", F.lit("")))
    return files.groupBy("package_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.sha2(entry, 256))), "\n"), 256).alias("digest"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(package_id) of packages whose digests differ, or that one side lacks."""
    both = before.join(after.withColumnRenamed("digest", "now"), "package_id", "full_outer")
    return both.filter(~F.col("digest").eqNullSafe(F.col("now"))).select("package_id")


def evaluate_unchanged(spark: SparkSession, policy: Policy, read: Callable[[], DataFrame], read_baseline: Callable[[], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`evaluate` over stores that are read anew before, during and after, as stored tables.

    ``read`` gives the files of the candidates, ``read_baseline`` those of the baseline. A package whose files, or whose baseline's
    files, aren't the same before and after gets an error of its own and keeps none of its verdicts: they may rest on either state.
    """
    sides = {"CANDIDATE_CHANGED_DURING_EVALUATION": read} | ({"BASELINE_CHANGED_DURING_EVALUATION": read_baseline} if read_baseline else {})
    before = {code: stored(fingerprints_of(side()), "before") for code, side in sides.items()}
    told = evaluate(spark, policy, read(), read_baseline() if read_baseline else None)
    _, statuses, findings = (stored(t, "gate") for t in told)
    moved = [drift(before[code], fingerprints_of(side())).select("package_id", F.lit(code).alias("code")) for code, side in sides.items()]
    changed = stored(reduce(DataFrame.union, moved), "changed")
    packages = before["CANDIDATE_CHANGED_DURING_EVALUATION"].select("package_id")
    # a package of the baseline alone has no verdict to take back
    concerned = changed.join(packages.union(changed.filter("code like 'CANDIDATE%'").select("package_id")).distinct(), "package_id", "left_semi")
    errors = gate.with_fingerprints(gate._findings(concerned, "integrity", F.col("code"), F.lit("files"), F.lit("changed"), "error")).withColumn("waiver_id", F.lit(None).cast("string"))
    kept = lambda rows: rows.join(concerned.select("package_id"), "package_id", "left_anti")
    failed = concerned.select("package_id", F.lit("integrity").alias("check_id"), F.lit("error").alias("status")).distinct()
    statuses = kept(statuses).select("package_id", "check_id", "status").unionByName(failed)
    every = packages.union(concerned.select("package_id")).distinct()
    return gate.outcomes(statuses, every), statuses, kept(findings).unionByName(errors, allowMissingColumns=True)
