"""Evidence packages as tables: directories and archives, manifests, inventories and record lines; and back."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trussline.model import RECORD_FILES
from trussline.operators import validate

_FILES = "package_id string, path string, content binary, error string"


@dataclass(frozen=True)
class Limits:
    """What an archive may hold; beyond it, the archive gives an error row and no files."""

    members: int = 10_000
    member_bytes: int = 512 << 20
    total_bytes: int = 2 << 30
    ratio: int = 200


def _hashed(files: DataFrame) -> DataFrame:
    return files.withColumns({"bytes": F.octet_length("content").cast("long"), "sha256": F.sha2("content", 256)})


def read_directories(spark: SparkSession, root: str) -> DataFrame:
    """(package_id, path, content, error, bytes, sha256) of every file under ``root``; its folders are the packages."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    parts = F.split(F.substring_index("path", root.rstrip("/").rsplit("/", 1)[-1] + "/", -1), "/", 2)
    return _hashed(rows.select(parts[0].alias("package_id"), parts[1].alias("path"), "content", F.lit(None).cast("string").alias("error")))


def _member_error(info: zipfile.ZipInfo, seen: set[str], limits: Limits) -> str | None:
    name = info.filename
    if name in seen:
        return "ARCHIVE_MEMBER_DUPLICATE"
    if not name or "\\" in name or "\0" in name or ":" in name or name.startswith("/") or any(p in ("", ".", "..") for p in name.split("/")):
        return "ARCHIVE_PATH_UNSAFE"
    if info.external_attr >> 28 == 0xA:
        return "ARCHIVE_SYMLINK"
    if info.flag_bits & 1:
        return "ARCHIVE_ENCRYPTED"
    if info.file_size > limits.member_bytes:
        return "ARCHIVE_MEMBER_TOO_LARGE"
    if info.file_size > limits.ratio * max(1, info.compress_size):
        return "ARCHIVE_RATIO_EXCEEDED"
    return None


def member_fault(members: list[zipfile.ZipInfo], limits: Limits) -> str | None:
    """The first rule that an archive's directory breaks."""
    error = "ARCHIVE_TOO_MANY_MEMBERS" if len(members) > limits.members else "ARCHIVE_TOO_LARGE" if sum(m.file_size for m in members) > limits.total_bytes else None
    seen: set[str] = set()
    for m in members:
        error = error or _member_error(m, seen, limits)
        seen.add(m.filename)
    return error


def open_archive(package: str, content: bytes, limits: Limits) -> Iterator[tuple[str, str | None, bytes | None, str | None]]:
    """Rows (package, path, content, error); an archive that breaks a rule gives that one row only."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            members = [m for m in archive.infolist() if not m.is_dir()]
            error = member_fault(members, limits)
            if error:
                yield package, None, None, error
                return
            for m in members:
                yield package, m.filename, archive.read(m), None
    except (zipfile.BadZipFile, OSError, RuntimeError, zlib.error) as problem:
        yield package, None, None, f"ARCHIVE_UNREADABLE: {type(problem).__name__}"


def read_archives(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """As :func:`read_directories`, for ZIP archives; the package is the archive's name. One archive is one row's work."""
    rows = spark.read.format("binaryFile").load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"]):
                for row in open_archive(name, content, limits):
                    yield pd.DataFrame([row], columns=["package_id", "path", "content", "error"])

    named = rows.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]+)?$", 1).alias("name"), "content")
    return _hashed(named.mapInPandas(run, _FILES))


def manifests(files: DataFrame) -> DataFrame:
    """One row a manifest, as columns. The version is the value of the key that ends in ``_version``."""
    doc = F.try_parse_json(F.decode("content", "UTF-8"))
    get = lambda path, kind="string": F.try_variant_get("doc", path, kind)
    version = F.filter(F.json_object_keys(F.to_json("doc")), lambda k: k.endswith("_version"))
    read = files.filter(F.col("path") == "manifest.json").select("package_id", doc.alias("doc"))
    artifact = "array<struct<path:string,sha256:string,bytes:bigint,media_type:string,role:string,authoritative:boolean>>"
    return read.select(
        "package_id",
        get("$.package_id").alias("named"),
        F.call_function("get_json_object", F.to_json("doc"), F.concat(F.lit("$."), F.get(version, 0))).alias("format_version"),
        get("$.created_at").alias("created_at"),
        get("$.package_form").alias("package_form"),
        get("$.source_embedding_policy").alias("source_embedding_policy"),
        get("$.logical_digest").alias("logical_digest"),
        get("$.source_ids", "array<string>").alias("source_ids"),
        get("$.loss_summary", "array<string>").alias("loss_summary"),
        F.coalesce(get("$.required_extensions", "array<string>"), F.array().cast("array<string>")).alias("required_extensions"),
        get("$.capabilities", "map<string,string>").alias("capabilities"),
        get("$.producer", "map<string,string>").alias("producer"),
        get("$.artifacts", artifact).alias("artifacts"),
        F.col("doc").isNull().alias("is_broken"),
    )


def inventory(packages: DataFrame) -> DataFrame:
    """(package_id, place, path, sha256, bytes, media_type, role, authoritative) of all manifests' artifacts."""
    return packages.select("package_id", F.posexplode("artifacts").alias("place", "a")).select("package_id", "place", "a.*")


def records(files: DataFrame) -> DataFrame:
    """(package_id, path, line, record_id, record_type, json) of the record files; blank lines count but give no row."""
    lines = files.filter(F.col("path").isin(*RECORD_FILES)).select("package_id", "path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\r?\n")).alias("at", "json"))
    doc = F.try_parse_json("json")
    return lines.filter(F.trim("json") != "").select("package_id", "path", (F.col("at") + 1).alias("line"), F.try_variant_get(doc, "$.record_id", "string").alias("record_id"), F.try_variant_get(doc, "$.record_type", "string").alias("record_type"), "json")


def validate_packages(files: DataFrame) -> DataFrame:
    """(package_id, code, path) of everything wrong with the packages of ``files``; valid packages have no row."""
    all_packages = files.select("package_id").distinct()
    packages = manifests(files)
    lines = records(files)
    good = packages.filter(~F.col("is_broken"))
    named = inventory(good)
    row = lambda rows, code, path: rows.select("package_id", F.lit(code).alias("code"), path.alias("path"))
    parts = [
        files.filter("error is not null").select("package_id", F.col("error").alias("code"), F.lit("").alias("path")),
        row(all_packages.join(packages, "package_id", "left_anti"), "MANIFEST_MISSING", F.lit("manifest.json")),
        row(packages.filter("is_broken"), "MANIFEST_INVALID", F.lit("manifest.json")),
        validate.check_manifests(good),
        validate.check_artifacts(named),
        validate.check_inventory(named, files, good),
        validate.check_digests(good, validate.logical_digests(named, files)),
        validate.check_records(lines),
        validate.check_schemas(lines),
        validate.check_evidence(lines.filter(F.try_parse_json("json").isNotNull())),
    ]
    return reduce(DataFrame.union, parts).distinct()


def jsonl_files(lines: DataFrame) -> DataFrame:
    """(package_id, path, content): record lines (package_id, path, record_id, json) sorted by id, one file each.

    A record file is bounded by the member limit, so its lines may meet in one row.
    """
    held = F.sort_array(F.collect_list(F.struct("record_id", "json")))
    text = F.concat(F.array_join(held["json"], "\n"), F.lit("\n"))
    return lines.groupBy("package_id", "path").agg(F.encode(text, "UTF-8").alias("content"))


def archives(files: DataFrame) -> DataFrame:
    """(package_id, archive): each package as a ZIP whose bytes depend on the files alone: order, times and modes are fixed.

    A package is bounded by :class:`Limits`, above which the run fails rather than cuts.
    """

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        if frame["content"].map(len).sum() > Limits.total_bytes or len(frame) > Limits.members:
            raise ValueError(f"package {frame['package_id'].iloc[0]} is above the limits")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as archive:
            for path, content in sorted(zip(frame["path"], frame["content"])):
                info = zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0))
                info.external_attr = 0o644 << 16
                info.create_system = 3
                info.compress_type = zipfile.ZIP_DEFLATED
                archive.writestr(info, content)
        return pd.DataFrame({"package_id": [frame["package_id"].iloc[0]], "archive": [out.getvalue()]})

    return files.select("package_id", "path", "content").groupBy("package_id").applyInPandas(build, "package_id string, archive binary")
