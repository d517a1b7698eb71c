"""Requests to and responses of external recognisers and converters, as tables to be checked and mapped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussline.functions.canon import canonical_json
from trussline.functions.values import HEX64


def request_id(configuration: Column, source_sha256: Column) -> Column:
    """Content-addressed id of a request: equal requests have equal ids, whatever the order of their keys."""
    return F.concat(F.lit("request_"), F.substring(F.sha2(F.concat(canonical_json(configuration), F.lit("\0"), source_sha256), 256), 1, 24))


def statement_digest(manifest: Column) -> Column:
    """Digest of a manifest as signed: canonical, without the form of the package. Folders and archives sign alike."""
    members = F.from_json(manifest, "map<string,string>")
    kept = F.map_filter(members, lambda k, v: k != "package_form")
    return F.sha2(F.concat(canonical_json(F.to_json(kept)), F.lit("\n")), 256)


def check_responses(requests: DataFrame, responses: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(response_id, code) for everything wrong with responses.

    requests (request_id, provider_id, capabilities array), responses (response_id, request_id, provider_id, payload,
    payload_sha256, attested_provider, network_mode, text), artifacts (response_id, content, sha256).
    """
    joined = responses.join(requests.select("request_id", F.col("provider_id").alias("asked")), "request_id", "left")
    row = lambda rows, code: rows.select("response_id", F.lit(code).alias("code"))
    parts = [
        row(joined.filter("asked is null"), "RESPONSE_REQUEST_UNKNOWN"),
        row(joined.filter("asked is not null and asked <> provider_id"), "RESPONSE_PROVIDER_MISMATCH"),
        row(joined.filter("not (attested_provider <=> provider_id)"), "RESPONSE_ATTESTATION_MISMATCH"),
        row(joined.filter(~F.coalesce(F.col("payload_sha256").rlike(HEX64) & (F.sha2("payload", 256) == F.col("payload_sha256")), F.lit(False))), "RESPONSE_PAYLOAD_MISMATCH"),
        row(joined.filter(F.col("payload").rlike(r"(?:^|[\s\"'=(])(?:/(?:home|root|tmp|var|usr|etc)/|[A-Za-z]:\\)")), "RESPONSE_HOST_PATH"),
        row(artifacts.filter("not (sha2(content, 256) <=> sha256)").select("response_id").distinct(), "RESPONSE_ARTIFACT_MISMATCH"),
    ]
    return reduce(DataFrame.union, parts)


def match_handles(observed: DataFrame, converted: DataFrame) -> DataFrame:
    """(package_id, handle, occurrence, state): decoder objects against the converted drawing's handles.

    A handle seen twice is conflicted in all its occurrences, numbered in the order of ``place``; one that the conversion
    doesn't have is unmatched.
    """
    by_handle = Window.partitionBy("package_id", "handle")
    numbered = observed.withColumns({"occurrence": F.row_number().over(by_handle.orderBy("place")) - 1, "times": F.count("*").over(by_handle)})
    joined = numbered.join(converted.select("package_id", "handle").distinct().withColumn("there", F.lit(True)), ["package_id", "handle"], "left")
    state = F.when(F.col("times") > 1, "conflicted").when(F.col("there").isNull(), "unmatched").otherwise("matched")
    return joined.select("package_id", "handle", "occurrence", state.alias("state"))


def product_labels(instances: DataFrame) -> DataFrame:
    """(package_id, id, label) of the products of an exchange file: the first string of the instance."""
    label = F.replace(F.regexp_extract("raw", r"PRODUCT\s*\(\s*'((?:[^']|'')*)'", 1), F.lit("''"), F.lit("'"))
    return instances.filter("original_class = 'PRODUCT'").select("package_id", "id", label.alias("label"))


def assembly_relations(instances: DataFrame) -> DataFrame:
    """(package_id, id, parent, child) of usage occurrences: the last two references of the instance, in order of writing."""
    refs = F.regexp_extract_all("raw", F.lit(r"#([0-9]+)"), F.lit(1))
    used = instances.filter("original_class = 'NEXT_ASSEMBLY_USAGE_OCCURRENCE'").withColumn("r", F.transform(refs, lambda x: x.cast("long")))
    return used.filter(F.size("r") >= 3).select("package_id", "id", F.element_at("r", -2).alias("parent"), F.element_at("r", -1).alias("child"))


def candidate_records(candidates: DataFrame, relationships: DataFrame) -> DataFrame:
    """(package_id, code, subject) for visual candidates whose relationships name one that isn't there."""
    ends = relationships.select("package_id", F.explode(F.array("subject_id", "object_id")).alias("candidate_id"))
    lost = ends.join(candidates.select("package_id", "candidate_id"), ["package_id", "candidate_id"], "left_anti").distinct()
    return lost.select("package_id", F.lit("CANDIDATE_REFERENCE_INVALID").alias("code"), F.col("candidate_id").alias("subject"))
