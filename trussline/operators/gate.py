"""Delivery gates: checks as functions from record tables to findings, waivers, and the verdict of each package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussline.functions.canon import fingerprint
from trussline.functions.values import during
from trussline.model import SEVERITIES, SUPPORT_LEVELS, rank, worst

FINDING = ("package_id", "check_id", "code", "subject_id", "observed_state", "disposition")


def _each_finding(rows: DataFrame, check_id: str, rules: list[tuple[Column, str | Column, Column, Column, str | Column]]) -> DataFrame:
    """A finding for each rule (condition, code, subject, state, disposition) that holds for a row, in one pass."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    found = [
        F.when(holds, F.struct(F.lit(check_id).alias("check_id"), as_column(code).alias("code"), subject.cast("string").alias("subject_id"), state.cast("string").alias("observed_state"), as_column(disposition).alias("disposition")))
        for holds, code, subject, state, disposition in rules
    ]
    return rows.select("package_id", F.inline(F.array_compact(F.array(*found))))


def _findings(rows: DataFrame, check_id: str, code: str | Column, subject: Column, state: Column, disposition: str | Column) -> DataFrame:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select("package_id", F.lit(check_id).alias("check_id"), as_column(code).alias("code"), subject.cast("string").alias("subject_id"), state.cast("string").alias("observed_state"), as_column(disposition).alias("disposition"))


def capability_minimum(capabilities: DataFrame, minima: dict[str, str], packages: DataFrame, check_id: str = "capability", on_fail: str = "fail") -> DataFrame:
    """Findings for capabilities (package_id, capability, level) below a policy's minimum level, or missing."""
    entries = F.array(*[F.struct(F.lit(c).alias("capability"), F.lit(m).alias("minimum")) for c, m in sorted(minima.items())])
    wanted = packages.select("package_id").distinct().select("package_id", F.inline(entries))
    seen = wanted.join(capabilities, ["package_id", "capability"], "left")
    low = rank(F.col("level"), SUPPORT_LEVELS, other=-1) < rank(F.col("minimum"), SUPPORT_LEVELS)
    code = F.when(F.col("level").isNull(), "CAPABILITY_MISSING").otherwise("CAPABILITY_BELOW_MINIMUM")
    return _findings(seen.filter(F.col("level").isNull() | low), check_id, code, F.col("capability"), F.coalesce("level", F.lit("missing")), on_fail)


def loss_maximum(declared: DataFrame, diagnostics: DataFrame, overall_max: int | None, maxima: DataFrame | None, check_id: str = "loss", on_fail: str = "fail") -> DataFrame:
    """Findings of declared losses (package_id, reason) against diagnostics (package_id, code, affected_count).

    A reason without a diagnostic, an invalid count (an error), the overall sum above its maximum, and reasons above
    theirs or, where maxima are given, not among them.
    """
    per_code = diagnostics.groupBy("package_id", F.col("code").alias("reason")).agg(F.sum("affected_count").alias("affected"), F.max((F.col("affected_count").isNull() | (F.col("affected_count") < 0)).cast("int")).alias("bad"))
    seen = declared.join(per_code, ["package_id", "reason"], "left")
    good, reason, affected = F.col("bad") == 0, F.col("reason"), F.col("affected")
    rules = [
        (F.col("bad").isNull(), "LOSS_EVIDENCE_MISSING", reason, F.lit("missing"), on_fail),
        (F.col("bad") == 1, "LOSS_EVIDENCE_INCONSISTENT", reason, F.lit("invalid_affected_count"), "error"),
    ]
    if maxima is not None:
        seen = seen.join(maxima, "reason", "left")
        rules.append((good & (F.col("maximum").isNull() | (affected > F.col("maximum"))), "LOSS_REASON_MAXIMUM_EXCEEDED", reason, affected, on_fail))
    out = _each_finding(seen, check_id, rules)
    if overall_max is not None:
        total = seen.filter(good).groupBy("package_id").agg(F.sum("affected").alias("affected")).filter(affected > overall_max)
        out = out.union(_findings(total, check_id, "LOSS_MAXIMUM_EXCEEDED", F.lit("loss.total"), affected, on_fail))
    return out


def value_state_action(states: DataFrame, actions: dict[str, str], check_id: str = "values", on_missing: str = "fail") -> DataFrame:
    """Findings of value states (package_id, subject, present, state): missing fields, invalid states, states not allowed."""
    action = F.create_map(*[F.lit(x) for pair in actions.items() for x in pair])[F.col("state")]
    rows = states.withColumn("action", F.when(F.col("state") == "known", "allow").otherwise(action))
    there, acts, subject = F.col("present"), F.col("action"), F.col("subject")
    rules = [
        (~there, "VALUE_FIELD_MISSING", subject, F.lit("missing"), on_missing),
        (there & acts.isNull(), "VALUE_STATE_INVALID", subject, F.lit("invalid"), "error"),
        (there & (acts == "requires_review"), "VALUE_STATE_REQUIRES_REVIEW", subject, F.col("state"), acts),
        (there & (acts == "fail"), "VALUE_STATE_FAILED", subject, F.col("state"), acts),
    ]
    return _each_finding(rows, check_id, rules)


def diagnostic_maximum(diagnostics: DataFrame, threshold: str, max_count: int, maxima: DataFrame | None, check_id: str = "diagnostics", on_fail: str = "fail") -> DataFrame:
    """Findings where the records at or above a severity are too many, in all or of one code. Rows are counted, not sums."""
    level = rank(F.col("severity"), SEVERITIES)
    invalid = F.coalesce(F.length("code") == 0, F.lit(True)) | level.isNull()
    out = _findings(diagnostics.filter(invalid), check_id, "DIAGNOSTIC_EVIDENCE_INVALID", F.col("record_id"), F.lit("invalid"), "error")
    counted = diagnostics.filter(~invalid & (level >= SEVERITIES.index(threshold))).groupBy("package_id", "code").agg(F.count("*").alias("n"))
    total = counted.groupBy("package_id").agg(F.sum("n").alias("n")).filter(F.col("n") > max_count)
    out = out.union(_findings(total, check_id, "DIAGNOSTIC_MAXIMUM_EXCEEDED", F.lit("diagnostics.total"), F.col("n"), on_fail))
    if maxima is not None:
        out = out.union(_findings(counted.join(maxima, "code").filter("n > maximum"), check_id, "DIAGNOSTIC_CODE_MAXIMUM_EXCEEDED", F.col("code"), F.col("n"), on_fail))
    return out


def diff_regression(changes: DataFrame, actions: dict[str, str], check_id: str = "regression") -> DataFrame:
    """Findings of changes (package_id, category, subject_id, observed_state) whose category's action isn't ``allow``."""
    action = F.create_map(*[F.lit(x) for pair in actions.items() for x in pair])[F.col("category")]
    acted = changes.withColumn("action", F.coalesce(action, F.lit("error"))).filter("action <> 'allow'")
    return _findings(acted, check_id, F.concat(F.lit("DIFF_"), F.upper("category")), F.col("subject_id"), F.col("observed_state"), F.col("action"))


def with_fingerprints(findings: DataFrame, refs: Column | None = None) -> DataFrame:
    refs = F.array("subject_id") if refs is None else refs
    return findings.withColumn("fingerprint", fingerprint(F.col("check_id"), F.col("code"), F.col("subject_id"), F.col("observed_state"), refs))


def waiver_states(waivers: DataFrame, findings: DataFrame, moment: Column) -> DataFrame:
    """``waivers`` (package_id, waiver_id, check_id, fingerprint, issued_at, expires_at) with their state at a moment.

    not_yet_valid, expired, mismatch (active, but there is no such finding) or active; the interval is half-open.
    """
    there = findings.select("package_id", "check_id", "fingerprint").distinct().withColumn("__found", F.lit(True))
    state = F.when(moment < F.col("issued_at"), "not_yet_valid").when(moment >= F.col("expires_at"), "expired").when(F.col("__found").isNull(), "mismatch").otherwise("active")
    return waivers.join(there, ["package_id", "check_id", "fingerprint"], "left").withColumn("state", state).drop("__found")


def apply_waivers(findings: DataFrame, waivers: DataFrame, moment: Column) -> DataFrame:
    """Findings with those waived that an active waiver names; errors can't be waived. The order of waivers is no matter."""
    active = waivers.filter(during(moment, F.col("issued_at"), F.col("expires_at"))).groupBy("package_id", "check_id", "fingerprint").agg(F.min("waiver_id").alias("waiver_id"))
    joined = findings.join(active, ["package_id", "check_id", "fingerprint"], "left")
    can = F.col("waiver_id").isNotNull() & F.col("disposition").isin("fail", "requires_review")
    return joined.withColumns({"disposition": F.when(can, "waived").otherwise(F.col("disposition")), "waiver_id": F.when(can, F.col("waiver_id"))})


def check_statuses(findings: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """(package_id, check_id, status): the worst disposition; at least requires_review where a waiver found nothing."""
    votes = findings.select("package_id", "check_id", "disposition")
    if states is not None:
        votes = votes.union(states.filter("state = 'mismatch'").select("package_id", "check_id", F.lit("requires_review")))
    return votes.groupBy("package_id", "check_id").agg(worst(F.col("disposition")).alias("status"))


def outcomes(statuses: DataFrame, packages: DataFrame) -> DataFrame:
    """(package_id, outcome, exit_code) of every package; a waived check still needs a review, no check is a pass."""
    status = packages.select("package_id").distinct().join(statuses, "package_id", "left").groupBy("package_id").agg(worst(F.col("status")).alias("s"))
    outcome = F.when(F.col("s") == "waived", "requires_review").otherwise(F.col("s"))
    code = F.when(outcome == "pass", 0).when(outcome == "error", 2).otherwise(1)
    return status.select("package_id", outcome.alias("outcome"), code.alias("exit_code"))


def annotation_level(severity: Column) -> Column:
    return F.when(severity.isin("error", "blocking"), "error").when(severity == "warning", "warning").otherwise("notice")


def annotations(verdicts: DataFrame, statuses: DataFrame, findings: DataFrame) -> DataFrame:
    """(package_id, kind, level, body) with a summary of each package, its checks and its findings as JSON text."""
    by_exit = F.when(F.col("exit_code") == 2, "error").when(F.col("exit_code") == 1, "warning").otherwise("notice")
    of_status = annotation_level(F.when(F.col("status").isin("fail", "error"), "error").when(F.col("status") == "requires_review", "warning").otherwise("info"))
    of_finding = annotation_level(F.when(F.col("disposition").isin("fail", "error"), "error").when(F.col("disposition") == "requires_review", "warning").otherwise("info"))
    parts = [
        verdicts.select("package_id", F.lit("summary").alias("kind"), by_exit.alias("level"), F.to_json(F.struct("exit_code", "outcome")).alias("body")),
        statuses.select("package_id", F.lit("check"), of_status, F.to_json(F.struct("check_id", "status"))),
        findings.select("package_id", F.lit("finding"), of_finding, F.to_json(F.struct("check_id", "code", "disposition", "observed_state", "subject_id"))),
    ]
    return parts[0].union(parts[1]).union(parts[2])


def markdown(verdicts: DataFrame, findings: DataFrame) -> DataFrame:
    """(package_id, place, line): the projection of a verdict, to be read in order of place; findings are inert code, sorted by their fields."""
    head = verdicts.select("package_id", F.lit(0).cast("long").alias("place"), F.format_string("# Delivery gate\n\nOutcome: `%s` (exit `%d`)\n", "outcome", "exit_code").alias("line"))
    place = F.row_number().over(Window.partitionBy("package_id").orderBy(*FINDING[1:])).cast("long")
    body = findings.select("package_id", place.alias("place"), F.concat(F.lit("    "), F.to_json(F.struct(*FINDING[1:]))).alias("line"))
    return head.union(body)


def finding_ids(findings: DataFrame, keys: list[str], order: list[str], prefix: str = "check", name: str = "finding_id") -> DataFrame:
    """``findings`` with a zero-padded running number behind ``prefix``, in order of ``order`` within ``keys``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return findings.withColumn(name, F.format_string(f"{prefix}-%04d", place))
