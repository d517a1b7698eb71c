"""Signature policy: lifecycle of keys, trust and authorisation, thresholds, revocation lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_keys(keys: DataFrame, moment: Column, kids: list[str], subjects: list[str], scopes: list[str]) -> DataFrame:
    """``keys`` (kid, subject, valid_from, valid_until, revocation_status, revoked_at, scopes) with three statuses.

    key_status by interval, then revocation; trusted if valid and named by id or subject; authorized if trusted and all
    required scopes are held.
    """
    revoked = (F.col("revocation_status") == "revoked") & (moment >= F.col("revoked_at"))
    key_status = (
        F.when(moment < F.col("valid_from"), "not_yet_valid")
        .when(moment >= F.col("valid_until"), "expired")
        .when(F.coalesce(revoked, F.lit(False)), "revoked")
        .when(F.col("revocation_status") == "unknown", "unknown_status")
        .otherwise("valid")
    )
    named = F.col("kid").isin(kids) | F.col("subject").isin(subjects)
    trust = F.when((F.col("key_status") == "valid") & named, "trusted").otherwise("untrusted")
    enough = F.size(F.array_except(F.array(*map(F.lit, scopes)), "scopes")) == 0 if scopes else F.lit(True)
    authorised = F.when((F.col("trust_status") == "trusted") & enough, "authorized").otherwise("unauthorized")
    return keys.withColumn("key_status", key_status).withColumn("trust_status", trust).withColumn("authorization_status", authorised)


def verify_bundles(signatures: DataFrame, keys: DataFrame, minimum: int) -> DataFrame:
    """(package_id, n_valid, n_authorized, verdict) from signatures (package_id, kid, is_valid) and evaluated keys.

    ``is_valid`` is the cryptographic verdict and comes from outside. Distinct authorised keys count once each.
    """
    joined = signatures.join(keys.select("kid", "authorization_status"), "kid", "left")
    good = F.col("is_valid") & (F.col("authorization_status") == "authorized")
    out = joined.groupBy("package_id").agg(F.count_if("is_valid").alias("n_valid"), F.count_distinct(F.when(good, F.col("kid"))).alias("n_authorized"), F.min("is_valid").alias("all_valid"))
    verdict = F.when(~F.col("all_valid"), "invalid").when(F.col("n_authorized") >= minimum, "verified").otherwise("unauthorized")
    return out.select("package_id", "n_valid", "n_authorized", verdict.alias("verdict"))


def revocation_status(certificates: DataFrame, lists: DataFrame, revoked: DataFrame, moment: Column) -> DataFrame:
    """``certificates`` (issuer, serial) with status good, revoked, unknown or stale at a moment.

    The newest list of the issuer decides: lists (issuer, list_id, last_update, next_update), revoked (list_id, serial,
    revoked_at). No list is unknown; one outside its interval is stale.
    """
    newest = lists.groupBy("issuer").agg(F.max_by(F.struct("list_id", "last_update", "next_update"), F.struct("last_update", "list_id")).alias("l")).select("issuer", "l.*")
    joined = certificates.join(newest, "issuer", "left").join(revoked, ["list_id", "serial"], "left")
    stale = F.col("next_update").isNull() | (moment < F.col("last_update")) | (moment >= F.col("next_update"))
    status = F.when(F.col("list_id").isNull(), "unknown").when(stale, "stale").when(F.coalesce(F.col("revoked_at") <= moment, F.lit(False)), "revoked").otherwise("good")
    return joined.select("issuer", "serial", status.alias("status"))


def advanced_verdicts(signatures: DataFrame, minimum: int, require_archival: bool) -> DataFrame:
    """(package_id, n_authorized, n_archived, policy_satisfied) over signatures with the verdicts on each.

    A signature (package_id, kid, cryptographic_status, lifecycle_status, trust_status, subject_allowed, scopes_allowed,
    archival_time_status) is authorised if it is valid, in its lifetime, trusted and allowed; the verdicts come from
    outside, null ones are no. Enough of them satisfy the policy, with a valid archival time on one of these if that is asked for.
    """
    is_so = lambda c, value: F.coalesce(F.col(c) == value, F.lit(False))
    authorised = is_so("cryptographic_status", "valid") & is_so("lifecycle_status", "valid") & is_so("trust_status", "trusted") & is_so("subject_allowed", True) & is_so("scopes_allowed", True)
    archived = authorised & is_so("archival_time_status", "valid")
    counted = signatures.groupBy("package_id").agg(F.count_if(authorised).alias("n_authorized"), F.count_if(archived).alias("n_archived"))
    enough = (F.col("n_authorized") >= minimum) & (F.lit(not require_archival) | (F.col("n_archived") > 0))
    return counted.withColumn("policy_satisfied", enough)
