import hashlib
import io
import json
import zipfile

import pytest

from trussline.model import RECORD_FILES
from trussline.sources import packages


def record(name, kind, **more):
    origin = {"producer_id": "p", "producer_version": "1", "method": "m", "recorded_at": "2024-01-01T00:00:00Z", "parent_record_ids": []}
    return json.dumps({"record_id": name, "record_type": kind, "record_version": "0.2", "source_refs": [], "provenance": origin, **more}, sort_keys=True)


def package(name, changes=None, manifest=None):
    files = {path: (record(f"{kind}-1", kind) + "\n" + record(f"{kind}-2", kind) + "\n").encode() for path, kind in RECORD_FILES.items()}
    files["context/index.md"] = b"# index\n"
    inventory = [{"path": p, "sha256": hashlib.sha256(c).hexdigest(), "bytes": len(c), "media_type": "x", "role": "r", "authoritative": True} for p, c in files.items()]
    lines = sorted(f"{a['path']}\0{a['sha256']}\0{a['bytes']}\n".encode() for a in inventory)
    head = {"format_version": "0.2.0", "package_id": name, "created_at": "2024-01-01T00:00:00Z", "producer": {"name": "p", "version": "1"}, "package_form": "directory", "source_embedding_policy": "external", "logical_digest": hashlib.sha256(b"".join(lines)).hexdigest(), "artifacts": inventory, "capabilities": {"mesh": "full"}, "loss_summary": [], "source_ids": ["s"], "required_extensions": []} | (manifest or {})
    files["manifest.json"] = json.dumps(head).encode()
    return files | (changes or {})


def write(root, name, files):
    for path, content in files.items():
        if content is not None:
            target = root / name / path
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(content)


@pytest.fixture
def store(tmp_path):
    bad_order = (record("entity-2", "entity") + "\n\n" + record("entity-1", "entity") + "\n{oops\n" + record("source-1", "entity")).encode()
    write(tmp_path / "store", "good", package("good"))
    write(tmp_path / "store", "order", package("order", {"model/entities.jsonl": bad_order}))
    write(tmp_path / "store", "missing", package("missing", {"context/index.md": None}))
    write(tmp_path / "store", "digest", package("digest", manifest={"logical_digest": "0" * 64, "required_extensions": ["x"], "package_form": "heap"}))
    write(tmp_path / "store", "none", {"readme": b"?"})
    write(tmp_path / "store", "broken", {"manifest.json": b"{"})
    evidence = [record("e1", "entity", representation_fidelity={"class": "preview", "derived": False, "source_representation_ids": ["a"]}), record("e2", "entity", coordinate_qualification={"global_location": {"state": "known", "value": 1}, "transform_chain": [{"state": "unknown", "reason_code": "x"}]})]
    evidence.append(record("e3", "entity", coordinate_qualification={"global_location": {"state": "unknown"}, "transform_chain": [{"state": "known", "matrix": [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1], "inverse_matrix": [2.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]}]}))
    evidence.append(record("e4", "entity", provider_attestation={"deterministic": True, "request_digest": "a" * 64, "response_digest": "b" * 64, "execution_mode": "network", "network_mode": "disabled", "provider_id": "p"}))
    write(tmp_path / "store", "rules", package("rules", {"model/entities.jsonl": "\n".join(evidence).encode()}))
    return tmp_path / "store"


def test_validation(spark, store):
    got = {}
    for r in packages.validate_packages(packages.read_directories(spark, str(store))).collect():
        got.setdefault(r.package_id, set()).add((r.code, r.path))
    entities = {("ARTIFACT_SIZE_MISMATCH", "model/entities.jsonl"), ("ARTIFACT_HASH_MISMATCH", "model/entities.jsonl"), ("LOGICAL_DIGEST_MISMATCH", "manifest.json#/logical_digest")}
    assert "good" not in got
    at = "model/entities.jsonl:"
    assert got["order"] == entities | {("RECORD_ORDER_INVALID", at + "3"), ("JSONL_INVALID", at + "4"), ("RECORD_ID_DUPLICATE", at + "5")}
    assert got["missing"] == {("ARTIFACT_MISSING", "context/index.md"), ("LOGICAL_DIGEST_MISMATCH", "manifest.json#/logical_digest")}
    assert got["digest"] == {("LOGICAL_DIGEST_MISMATCH", "manifest.json#/logical_digest"), ("REQUIRED_EXTENSION_UNSUPPORTED", "manifest.json#/required_extensions"), ("SCHEMA_INVALID", "manifest.json#/package_form")}
    assert got["none"] == {("MANIFEST_MISSING", "manifest.json")} and got["broken"] == {("MANIFEST_INVALID", "manifest.json")}
    assert got["rules"] == entities | {("FIDELITY_DERIVATION_INVALID", at + "1"), ("COORDINATE_GLOBAL_STATE_INVALID", at + "2"), ("COORDINATE_INVERSE_INVALID", at + "3"), ("ATTESTATION_NETWORK_INVALID", at + "4")}


def test_archives_give_the_same_tables(spark, store, tmp_path):
    files = packages.read_directories(spark, str(store)).filter("package_id in ('good', 'order')")
    zips = tmp_path / "zips"
    zips.mkdir()
    first = {r.package_id: bytes(r.archive) for r in packages.archives(files).collect()}
    assert first == {r.package_id: bytes(r.archive) for r in packages.archives(files.repartition(3)).collect()}
    for name, data in first.items():
        (zips / f"{name}.zip").write_bytes(data)
    back = packages.read_archives(spark, f"{zips}/*.zip")
    key = lambda df: sorted(tuple(r) for r in df.select("package_id", "path", "sha256", "bytes").collect())
    assert key(back) == key(files)
    info = packages.manifests(back).filter("package_id = 'good'").first()
    assert info.format_version == "0.2.0" and info.capabilities == {"mesh": "full"} and len(info.artifacts) == 7


@pytest.mark.parametrize(
    "name, error",
    [("../x", "ARCHIVE_PATH_UNSAFE"), ("/x", "ARCHIVE_PATH_UNSAFE"), ("a/./b", "ARCHIVE_PATH_UNSAFE"), ("zeros", "ARCHIVE_RATIO_EXCEEDED"), ("link", "ARCHIVE_SYMLINK"), ("twice", "ARCHIVE_MEMBER_DUPLICATE"), ("ok", None)],
)
def test_archive_rules(name, error):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        info = zipfile.ZipInfo(name)
        info.compress_type = zipfile.ZIP_DEFLATED
        info.external_attr = (0o120777 if name == "link" else 0o644) << 16
        z.writestr(info, b"\0" * (1 << 20) if name == "zeros" else b"text")
        if name == "twice":
            z.writestr(zipfile.ZipInfo(name), b"more")
    rows = list(packages.open_archive("p", data.getvalue(), packages.Limits()))
    assert rows[0][3] == error and (rows[0][2] == b"text") == (error is None)
    assert next(packages.open_archive("p", b"PK no", packages.Limits()))[3].startswith("ARCHIVE_UNREADABLE")


def test_jsonl_round_trip(spark, store):
    files = packages.read_directories(spark, str(store)).filter("package_id = 'good'")
    made = packages.jsonl_files(packages.records(files))
    both = made.join(files.withColumnRenamed("content", "was"), ["package_id", "path"])
    assert both.filter("content = was").count() == 6


def test_stream_equals_batch(spark, store, tmp_path):
    from trussline.streaming import ingest

    folder = tmp_path / "lines"
    folder.mkdir()
    for k, path in enumerate(RECORD_FILES):
        (folder / f"{k}.jsonl").write_bytes((store / "good" / path).read_bytes())
    records = ingest.stream_records(spark, str(folder), max_files=2)
    ingest.keep_ingesting(records, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
    (folder / "more.jsonl").write_text(record("x", "entity") + "\n")
    ingest.keep_ingesting(ingest.stream_records(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 13
    counts = ingest.stream_counts(ingest.stream_records(spark, str(folder)))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.record_type: r.n for r in spark.table("counts").collect()}["entity"] == 3


def test_record_schemas(spark):
    from trussline.operators import validate

    whole = json.loads(record("a", "entity", source_refs=[{"source_id": "s", "locator": "l"}], extensions={}))
    origin = whole["provenance"]
    cases = [
        (whole, []),
        ({k: v for k, v in whole.items() if k not in ("provenance", "source_refs")}, [""]),
        (whole | {"record_version": "9", "extensions": 1}, ["#/extensions", "#/record_version"]),
        (whole | {"record_version": 0.1, "source_refs": {}}, ["#/record_version", "#/source_refs"]),
        (whole | {"source_refs": [{"source_id": "s", "locator": ""}, 5, {"source_id": "s"}, {"source_id": "s", "locator": "l", "x": 1}]}, ["#/source_refs/0/locator", "#/source_refs/1", "#/source_refs/2", "#/source_refs/3"]),
        (whole | {"provenance": None}, ["#/provenance"]),
        (whole | {"provenance": origin | {"method": "", "recorded_at": "today", "parent_record_ids": ["x", "x"]}}, ["#/provenance/method", "#/provenance/parent_record_ids", "#/provenance/recorded_at"]),
        (whole | {"provenance": {k: v for k, v in origin.items() if k != "method"} | {"parent_record_ids": [1]}}, ["#/provenance", "#/provenance/parent_record_ids"]),
        (whole | {"provenance": origin | {"more": 1}}, ["#/provenance"]),
        ([1], [""]),
    ]
    rows = [("p", "f", k, json.dumps(doc)) for k, (doc, _) in enumerate(cases)] + [("p", "f", 99, "{"), ("p", "f", 98, None)]
    got = {}
    for r in validate.check_schemas(spark.createDataFrame(rows, "package_id string, path string, line long, json string")).collect():
        got.setdefault(int(r.path.split("#")[0][2:]), []).append(r.path[len("f:0") :])
    assert {k: sorted(v) for k, v in got.items()} == {k: want for k, (_, want) in enumerate(cases) if want}


def test_manifest_fields(spark):
    from pyspark.sql import functions as F

    from trussline.operators import validate

    kind = "package_id string, place int, path string, sha256 string, bytes long, media_type string, role string, authoritative boolean"
    entries = spark.createDataFrame([("p", 0, "a/b", "0" * 64, 0, "x", "r", True), ("p", 1, "a/../b", "0", -1, "", None, None)], kind)
    assert sorted(r.path for r in validate.check_artifacts(entries).collect()) == [f"manifest.json#/artifacts/1/{f}" for f in ("authoritative", "bytes", "media_type", "path", "role", "sha256")]
    good = {"created_at": F.lit("2024-01-01T00:00:00Z"), "producer": F.create_map(F.lit("name"), F.lit("n"), F.lit("version"), F.lit("1")), "source_ids": F.array(F.lit("s")), "capabilities": F.create_map(F.lit("mesh"), F.lit("full")), "loss_summary": F.array().cast("array<string>")}
    base = spark.range(1).select(F.lit("p").alias("package_id"), F.lit("0.2.0").alias("format_version"), F.lit("0" * 64).alias("logical_digest"), F.lit("zip").alias("package_form"), F.lit("external").alias("source_embedding_policy"), F.array().cast("array<string>").alias("required_extensions"))
    assert validate.check_manifests(base.withColumns(good)).count() == 0
    bad = {"created_at": F.lit("now"), "producer": F.create_map(F.lit("name"), F.lit("n")), "source_ids": F.array(F.lit("s"), F.lit("s")), "capabilities": F.create_map(F.lit("mesh"), F.lit("some")), "loss_summary": F.array(F.lit(""))}
    assert sorted(r.path for r in validate.check_manifests(base.withColumns(bad)).collect()) == sorted(f"manifest.json#/{f}" for f in bad)
    empty = {name: F.lit(None).cast(base.withColumns(good).schema[name].dataType) for name in good}
    assert validate.check_manifests(base.withColumns(empty)).count() == 5


def test_record_lines_are_sorted_in_all_tasks_of_a_shuffle(spark):
    from pyspark.sql import functions as F

    from trussline.operators import validate

    n = 4000
    lines = spark.range(n).select((F.col("id") % 50).alias("package_id"), F.lit("records/entities.jsonl").alias("path"), F.col("id").alias("line"), F.format_string("entity-%d", F.col("id") % 1000).alias("record_id"), F.lit("entity").alias("record_type"), F.lit("{}").alias("json"))
    found = validate.check_records(lines).filter("code = 'RECORD_ID_DUPLICATE'")
    assert {(r.package_id, r.path) for r in found.collect()} == {(k % 50, f"records/entities.jsonl:{k}") for k in range(1000, n)}
    # small as they are sent, so adaptive execution would join them into few tasks
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
