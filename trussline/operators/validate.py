"""Validation of packages: each rule gives rows of (package_id, code, path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussline.functions.canon import inventory_line, ordered_digests
from trussline.functions.values import HEX64, attestation_error, fidelity_error, inference_error, inverse_matches, safe_path
from trussline.model import RECORD_FILES, RECORD_TYPES, REQUIRED_ARTIFACTS, SUPPORT_LEVELS

#: A date and time with its offset.
DATE_TIME = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
# Fixed values of the record schema.
RECORD_VERSIONS = ("0.1", "0.2")
PROVENANCE = ("producer_id", "producer_version", "method", "recorded_at", "parent_record_ids")
SOURCE_REF = ("source_id", "locator")


def _rows(rows: DataFrame, code: str | Column, path: Column) -> DataFrame:
    return rows.select("package_id", (F.lit(code) if isinstance(code, str) else code).alias("code"), path.alias("path"))


def _each(rows: DataFrame, rules: list[tuple[Column, str, Column]]) -> DataFrame:
    """A row for each rule (condition, code, path) that a row breaks, in one pass."""
    broken = [F.when(holds, F.struct(F.lit(code).alias("code"), path.alias("path"))) for holds, code, path in rules]
    return rows.select("package_id", F.inline(F.array_compact(F.array(*broken))))


def check_inventory(inventory: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """Inventories (package_id, place, path, sha256, bytes) against files (package_id, path, sha256, bytes).

    Repeated paths count once more than their first; missing files, sizes and hashes that differ, and required artifacts
    that no entry names.
    """
    nth = F.row_number().over(Window.partitionBy("package_id", "path").orderBy("place"))
    found = files.select("package_id", "path", F.col("sha256").alias("is_sha"), F.col("bytes").alias("is_bytes"))
    both = inventory.withColumn("nth", nth).join(found, ["package_id", "path"], "left")
    required = packages.select("package_id").withColumn("path", F.explode(F.array(*map(F.lit, REQUIRED_ARTIFACTS))))
    path, first, there = F.col("path"), F.col("nth") == 1, F.col("is_sha").isNotNull()
    rules = [
        (F.col("nth") > 1, "ARTIFACT_PATH_DUPLICATE", path),
        (first & ~there, "ARTIFACT_MISSING", path),
        (first & there & ~F.col("bytes").eqNullSafe(F.col("is_bytes")), "ARTIFACT_SIZE_MISMATCH", path),
        (first & there & ~F.col("sha256").eqNullSafe(F.col("is_sha")), "ARTIFACT_HASH_MISMATCH", path),
        (first & ~safe_path(path), "PATH_UNSAFE", path),
    ]
    unnamed = required.join(inventory.select("package_id", "path"), ["package_id", "path"], "left_anti")
    return _each(both, rules).union(_rows(unnamed, "REQUIRED_ARTIFACT_MISSING", path))


def logical_digests(inventory: DataFrame, files: DataFrame) -> DataFrame:
    """(package_id, logical_digest) over the inventoried files that are there; a repeated path counts once."""
    named = inventory.select("package_id", "path").distinct().join(files, ["package_id", "path"])
    return ordered_digests(named, "package_id", inventory_line(F.col("path"), F.col("sha256"), F.col("bytes")), "logical_digest")


def check_digests(packages: DataFrame, digests: DataFrame) -> DataFrame:
    both = packages.select("package_id", F.col("logical_digest").alias("said")).join(digests, "package_id", "left")
    return _rows(both.filter("not (said <=> logical_digest)"), "LOGICAL_DIGEST_MISMATCH", F.lit("manifest.json#/logical_digest"))


def check_manifests(packages: DataFrame, versions: tuple[str, ...] = ("0.1.0", "0.2.0"), extensions: tuple[str, ...] = ()) -> DataFrame:
    """Versions that aren't known, fields of the wrong form, and required extensions that aren't supported.

    created_at, producer, source_ids, capabilities and loss_summary are looked at where the table has them.
    """
    known = F.coalesce(F.col("format_version").isin(*versions), F.lit(False))
    at = lambda field: F.lit(f"manifest.json#/{field}")
    bad = {
        "package_id": F.coalesce(F.length("package_id"), F.lit(0)) == 0,
        "logical_digest": ~F.coalesce(F.col("logical_digest").rlike(HEX64), F.lit(False)),
        "package_form": ~F.coalesce(F.col("package_form").isin("directory", "zip"), F.lit(False)),
        "source_embedding_policy": ~F.coalesce(F.col("source_embedding_policy").isin("external", "embedded", "redacted"), F.lit(False)),
    }
    no = lambda holds: ~F.coalesce(holds, F.lit(False))
    filled = lambda name: F.forall(name, lambda x: F.coalesce(F.length(x) > 0, F.lit(False)))
    more = {
        "created_at": lambda: no(F.col("created_at").rlike(DATE_TIME)),
        "producer": lambda: no((F.size("producer") == 2) & (F.length(F.try_element_at("producer", F.lit("name"))) > 0) & (F.length(F.try_element_at("producer", F.lit("version"))) > 0)),
        "source_ids": lambda: no((F.size("source_ids") > 0) & filled("source_ids") & (F.size(F.array_distinct("source_ids")) == F.size("source_ids"))),
        "capabilities": lambda: no((F.size("capabilities") > 0) & F.forall(F.map_values("capabilities"), lambda x: F.coalesce(x.isin(*SUPPORT_LEVELS), F.lit(False)))),
        "loss_summary": lambda: no(filled("loss_summary")),
    }
    bad |= {field: wrong() for field, wrong in more.items() if field in packages.columns}
    lacking = F.size(F.array_except("required_extensions", F.array(*map(F.lit, extensions)).cast("array<string>"))) > 0
    rules = [(~known, "VERSION_UNSUPPORTED", at("version")), (F.coalesce(lacking, F.lit(False)), "REQUIRED_EXTENSION_UNSUPPORTED", at("required_extensions"))]
    return _each(packages, rules + [(known & wrong, "SCHEMA_INVALID", at(field)) for field, wrong in bad.items()])


def check_artifacts(inventory: DataFrame) -> DataFrame:
    """Entries (package_id, place, path, sha256, bytes, media_type, role, authoritative) whose fields are missing or of the wrong form."""
    at = lambda field: F.format_string(f"manifest.json#/artifacts/%d/{field}", F.col("place"))
    good = {
        "path": F.col("path").rlike(r"^(?!/)(?!.*(?:^|/)\.\.(?:/|$)).+"),
        "sha256": F.col("sha256").rlike(HEX64),
        "bytes": F.col("bytes") >= 0,
        "media_type": F.length("media_type") > 0,
        "role": F.length("role") > 0,
        "authoritative": F.col("authoritative").isNotNull(),
    }
    return _each(inventory, [(~F.coalesce(holds, F.lit(False)), "SCHEMA_INVALID", at(field)) for field, holds in good.items()])


def check_schemas(records: DataFrame) -> DataFrame:
    """Lines (package_id, path, line, json) whose common fields haven't the form of the record schema, one row a place.

    A missing or surplus field is told at the object, a wrong value at itself. record_id and record_type are told by
    :func:`check_records`, as are lines that are no JSON.
    """
    get = lambda at, kind: F.try_variant_get("doc", at, kind)
    kind = lambda at: F.schema_of_variant(F.variant_get("doc", at, "variant"))
    pointer = lambda at: F.lit(at.removeprefix("$").replace(".", "/"))
    is_text = lambda value: F.coalesce((F.schema_of_variant(value) == "STRING") & (F.try_variant_get(value, "$", "string") != ""), F.lit(False))
    surplus = lambda value, names: F.size(F.array_except(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")), F.array(*map(F.lit, names)))) > 0

    def field(at: str, good: Column) -> Column:
        holder = at.rsplit(".", 1)[0]
        return F.when(kind(at).isNull(), pointer(holder)).when(~F.coalesce(good, F.lit(False)), pointer(at))

    def ref(value: Column, i: Column) -> Column:
        here = F.concat(F.lit("/source_refs/"), i.cast("string"))
        part = lambda name: F.try_variant_get(value, f"$.{name}", "variant")
        fields = [F.when(part(n).isNull(), here).when(~is_text(part(n)), F.concat(here, F.lit(f"/{n}"))) for n in SOURCE_REF]
        return F.when(~F.schema_of_variant(value).startswith("OBJECT"), F.array(here)).otherwise(F.array_compact(F.array(F.when(surplus(value, SOURCE_REF), here), *fields)))

    p, parents = "$.provenance", get("$.provenance.parent_record_ids", "array<variant>")
    texts = F.transform(parents, lambda x: F.try_variant_get(x, "$", "string"))
    in_object = [field(f"{p}.{n}", is_text(F.variant_get("doc", f"{p}.{n}", "variant"))) for n in PROVENANCE[:3]]
    in_object.append(field(f"{p}.recorded_at", (kind(f"{p}.recorded_at") == "STRING") & get(f"{p}.recorded_at", "string").rlike(DATE_TIME)))
    in_object.append(field(f"{p}.parent_record_ids", F.forall(parents, lambda x: F.schema_of_variant(x) == "STRING") & (F.size(F.array_distinct(texts)) == F.size(texts))))
    in_object.append(F.when(surplus(F.variant_get("doc", p, "variant"), PROVENANCE), pointer(p)))
    is_object = F.coalesce(kind(p).startswith("OBJECT"), F.lit(False))
    refs = get("$.source_refs", "array<variant>")
    none = F.array().cast("array<string>")
    told = F.concat(
        F.array_compact(F.array(field("$.record_version", get("$.record_version", "string").isin(*RECORD_VERSIONS) & (kind("$.record_version") == "STRING")), field("$.source_refs", refs.isNotNull()), field(p, is_object), F.when(~kind("$.extensions").startswith("OBJECT"), pointer("$.extensions")))),
        F.coalesce(F.flatten(F.transform(refs, ref)), none),
        F.when(is_object, F.array_compact(F.array(*in_object))).otherwise(none),
    )
    told = F.when(kind("$").startswith("OBJECT"), F.array_distinct(told)).otherwise(F.array(F.lit("")))
    rows = records.withColumn("doc", F.try_parse_json("json")).filter("doc is not null").withColumn("pointer", F.explode(told))
    return _rows(rows, "SCHEMA_INVALID", F.concat(F.format_string("%s:%d", F.col("path"), F.col("line")), F.when(F.col("pointer") != "", F.concat(F.lit("#"), "pointer")).otherwise("")))


def check_records(records: DataFrame) -> DataFrame:
    """Lines (package_id, path, line, record_id, record_type, json) that are no JSON, of the wrong form, repeated or out of order.

    A repeat is any line but the first of its id in the order of the files. Order is told against the line before that
    has an id, within a file. Lines are sorted without their JSON, and dealt into as many tasks as the session shuffles
    to: much alike lines are small as they are sent, and what their size joins into one task is many times larger once sorted there.
    """
    at = F.format_string("%s:%d", F.col("path"), F.col("line"))
    broken = F.try_parse_json(F.col("json")).isNull()
    named = ~broken & F.coalesce(F.length("record_id") > 0, F.lit(False))
    place = F.array_position(F.array(*map(F.lit, RECORD_FILES)), F.col("path"))
    nth = F.row_number().over(Window.partitionBy("package_id", "record_id").orderBy(~F.col("named"), place, "line"))
    before = F.last(F.when(F.col("named"), F.col("record_id")), ignorenulls=True).over(Window.partitionBy("deal", "package_id", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    typed = F.coalesce(F.col("record_type").isin(*RECORD_TYPES), F.lit(False))
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = records.select("package_id", "path", "line", "record_id", broken.alias("broken"), named.alias("named"), typed.alias("typed"))
    # dealt by a hash, as a constant path would be dropped from the window's keys, and these rows dealt once more
    counted = slim.repartition(parts, "package_id", "record_id").withColumns({"nth": nth, "deal": F.xxhash64("package_id", "path")})
    rows = counted.repartition(parts, "deal").withColumn("before", before)
    is_named, whole = F.col("named"), ~F.col("broken")
    rules = [
        (F.col("broken"), "JSONL_INVALID", at),
        (whole & ~is_named, "SCHEMA_INVALID", F.concat(at, F.lit("#/record_id"))),
        (whole & ~F.col("typed"), "SCHEMA_INVALID", F.concat(at, F.lit("#/record_type"))),
        (is_named & (F.col("nth") > 1), "RECORD_ID_DUPLICATE", at),
        (is_named & F.coalesce(F.col("record_id") < F.col("before"), F.lit(False)), "RECORD_ORDER_INVALID", at),
    ]
    return _each(rows, rules)


def check_evidence(records: DataFrame) -> DataFrame:
    """Rules of the second version: fidelity, attestation, inference and coordinates of records (package_id, path, line, json)."""
    doc = F.parse_json(F.col("json"))
    get = lambda path, kind: F.try_variant_get(doc, path, kind)
    there = lambda path: F.coalesce(F.schema_of_variant(F.variant_get(doc, path, "variant")).startswith("OBJECT"), F.lit(False))
    fidelity = F.when(there("$.representation_fidelity"), fidelity_error(get("$.representation_fidelity.class", "string"), get("$.representation_fidelity.derived", "boolean"), get("$.representation_fidelity.source_representation_ids", "array<string>")))
    a = "$.provider_attestation"
    attested = F.when(there(a), attestation_error(get(f"{a}.deterministic", "boolean"), get(f"{a}.request_digest", "string"), get(f"{a}.response_digest", "string"), get(f"{a}.execution_mode", "string"), get(f"{a}.network_mode", "string"), get(f"{a}.provider_id", "string")))
    i = "$.inference"
    numeric = lambda path: F.when(F.schema_of_variant(F.variant_get(doc, path, "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), get(path, "double"))
    inferred = F.when(
        there(i),
        inference_error(
            [get(f"{i}.{x}", "string") for x in ("input_artifact_sha256", "input_region_sha256", "request_digest", "response_digest")],
            [numeric(f"{i}.{x}") for x in ("extraction_confidence", "interpretation_confidence")],
            *[get(f"{i}.{x}", "string") for x in ("reproducibility", "provider_id", "provider_version", "execution_mode", "verification_state")],
        ),
    )
    c = "$.coordinate_qualification"
    links = get(f"{c}.transform_chain", "array<struct<state:string,matrix:array<double>,inverse_matrix:array<double>>>")
    state = get(f"{c}.global_location.state", "string")
    tolerance = F.coalesce(F.when(get(f"{c}.tolerance.state", "string") == "known", get(f"{c}.tolerance.value", "double")), F.lit(1e-6))
    tolerance = F.when(tolerance > 0, tolerance).otherwise(1e-6)
    coordinate = F.when(
        there(c),
        F.when(links.isNull() | state.isNull(), "COORDINATE_STRUCTURE_INVALID")
        .when((state == "known") & F.exists(links, lambda x: ~F.coalesce(x["state"] == "known", F.lit(False))), "COORDINATE_GLOBAL_STATE_INVALID")
        .when(F.exists(links, lambda x: (x["state"] == "known") & ~inverse_matches(x["matrix"], x["inverse_matrix"], tolerance)), "COORDINATE_INVERSE_INVALID"),
    )
    codes = records.withColumn("code", F.explode(F.array_compact(F.array(coordinate, fidelity, attested, inferred))))
    return _rows(codes, F.col("code"), F.format_string("%s:%d", F.col("path"), F.col("line")))


def check_provider_events(events: DataFrame) -> DataFrame:
    """Events (package_id, response_id, sequence) of responses whose sequence is not 0, 1, 2 and so on."""
    place = F.row_number().over(Window.partitionBy("package_id", "response_id").orderBy("sequence")) - 1
    gaps = events.withColumn("place", place).filter("not (sequence <=> place)")
    return _rows(gaps.groupBy("package_id", "response_id").agg(F.min("place").alias("place")), "EVENT_SEQUENCE_INVALID", F.concat_ws("#", "response_id", F.col("place").cast("string")))
