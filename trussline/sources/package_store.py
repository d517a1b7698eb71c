"""Package archives as Spark data sources: members are partitions that filters prune, and packages are written in two phases.

``package_files`` gives (package_id, path, content, error), ``package_records`` (package_id, path, line, record_id, record_type,
json, error) of the record files. Planning reads the directories of the archives, not their members. What is asked of package, path and record type
decides which members are opened at all, be it named when loading or pushed down from a filter.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import Row, StructType

from trussline.model import RECORD_FILES
from trussline.sources.packages import Limits, member_fault
from trussline.storage import file_system, in_runs, stored

#: Directories that planning reads at a time, and bytes of small members that share a task.
THREADS, TASK_BYTES = 16, 32 << 20
#: Bytes of lines that a reader hands over at once, about.
BATCH_BYTES = 4 << 20
MISPLACED = "RECORD_TYPE_MISPLACED"
#: Columns by which members are pruned.
ASKED = ("package_id", "path", "record_type")


@dataclass(frozen=True)
class Member:
    archive: str
    package: str
    path: str | None
    size: int
    error: str | None = None


@dataclass
class Members(InputPartition):
    """What one task reads."""

    members: list[Member]
    value: object = field(default=None)


def archive_members(system: fs.FileSystem, path: str, limits: Limits) -> list[Member]:
    """The members that an archive's directory names, or one row with its fault; no member is opened."""
    package = re.sub(r"\.[^./]+$", "", path.rsplit("/", 1)[-1])
    try:
        with system.open_input_file(path) as source, zipfile.ZipFile(source) as archive:
            infos = [m for m in archive.infolist() if not m.is_dir()]
            error = member_fault(infos, limits)
            if error:
                return [Member(path, package, None, 0, error)]
            return [Member(path, package, m.filename, m.file_size) for m in infos]
    except (zipfile.BadZipFile, OSError, pa.ArrowInvalid, zlib.error) as problem:
        return [Member(path, package, None, 0, f"ARCHIVE_UNREADABLE: {type(problem).__name__}")]


def _texts(f: Filter) -> list | None:
    """The values that a filter asks a column to equal."""
    if isinstance(f, (EqualTo, EqualNullSafe)):
        return [f.value]
    return list(f.value) if isinstance(f, In) else None


class ArchiveReader(DataSourceReader):
    """Plans by directories; ``wanted`` holds what is asked of package, path and record type."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.limits = Limits(*(int(options.get(c, getattr(Limits, c))) for c in ("members", "member_bytes", "total_bytes", "ratio")))
        self.wanted: list[Filter] = [In((c,), tuple(json.loads(options[f"{c}s"]))) for c in ASKED if f"{c}s" in options]

    def _keeps(self, member: Member) -> bool:
        told = {"package_id": member.package, "path": member.path, "record_type": RECORD_FILES.get(member.path)}
        for f in self.wanted:
            value = told[f.attribute[0]]
            texts = _texts(f)
            if texts is not None:
                fits = value in texts
            elif isinstance(f, (StringStartsWith, StringEndsWith, StringContains)):
                fits = value is not None and {StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__}[type(f)](value, f.value)
            else:
                fits = True
            if not fits:
                return False
        return True

    def _is_read(self, member: Member) -> bool:
        return True

    def partitions(self) -> list[Members]:
        system, root = file_system(self.folder)
        info = system.get_file_info(root)
        paths = [root] if info.is_file else sorted(i.path for i in system.get_file_info(fs.FileSelector(root)) if i.is_file and i.path.endswith(".zip"))
        names = [f for f in self.wanted if f.attribute == ("package_id",)]
        package_of = lambda p: re.sub(r"\.[^./]+$", "", p.rsplit("/", 1)[-1])
        paths = [p for p in paths if all(_texts(f) is None or package_of(p) in _texts(f) for f in names)]
        with ThreadPoolExecutor(THREADS) as pool:
            found = [m for members in pool.map(lambda p: archive_members(system, p, self.limits), paths) for m in members if self._is_read(m) and self._keeps(m)]
        out: list[Members] = []
        room = 0
        for m in found:
            if m.size > room or not out:
                out.append(Members([]))
                room = TASK_BYTES
            out[-1].members.append(m)
            room -= m.size
        return out

    def read(self, partition: Members | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, _ = file_system(self.folder)
        opened: tuple[str, zipfile.ZipFile] | None = None
        for member in partition.members:
            if member.error:
                yield self.rows_of(member, None)
                continue
            if opened is None or opened[0] != member.archive:
                opened = member.archive, zipfile.ZipFile(system.open_input_file(member.archive))
            try:
                with opened[1].open(member.path) as source:
                    yield from self.batches_of(member, source)
            except (zipfile.BadZipFile, OSError, RuntimeError, pa.ArrowInvalid, zlib.error) as problem:
                yield self.rows_of(Member(member.archive, member.package, member.path, 0, f"ARCHIVE_UNREADABLE: {type(problem).__name__}"), None)


class FileReader(ArchiveReader):
    def rows_of(self, member: Member, content: bytes | None) -> pa.RecordBatch:
        values = {"package_id": pa.array([member.package]), "path": pa.array([member.path], pa.string()), "content": pa.array([content], pa.binary()), "error": pa.array([member.error], pa.string())}
        return pa.RecordBatch.from_pydict(values)

    def batches_of(self, member: Member, source: io.BufferedIOBase) -> Iterator[pa.RecordBatch]:
        yield self.rows_of(member, source.read())


class Pushing:
    """A reader that also takes filters; Spark applies all of them again."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.wanted += [f for f in filters if f.attribute in {(c,) for c in ASKED}]
        return filters


class PushingFileReader(Pushing, FileReader):
    pass


class RecordReader(ArchiveReader):
    """Lines of record files; a record of a type that isn't its file's has an error and no type, so pruning by type loses no row."""

    _FIELDS = {"package_id": pa.string(), "path": pa.string(), "line": pa.int64(), "record_id": pa.string(), "record_type": pa.string(), "json": pa.string(), "error": pa.string()}

    def _is_read(self, member: Member) -> bool:
        return member.path in RECORD_FILES or member.error is not None

    def _rows(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self._FIELDS.values())], list(self._FIELDS))

    def rows_of(self, member: Member, content: bytes | None) -> pa.RecordBatch:
        return self._rows([(member.package, member.path, None, None, None, None, member.error)])

    def batches_of(self, member: Member, source: io.BufferedIOBase) -> Iterator[pa.RecordBatch]:
        rows, size, kind = [], 0, RECORD_FILES[member.path]
        for line, raw in enumerate(source, 1):
            text = raw.decode("utf-8", "replace").rstrip("\r\n")
            if not text.strip(" "):
                continue
            try:
                doc = json.loads(text)
            except ValueError:
                doc = None
            told = [doc.get(c) if isinstance(doc, dict) and isinstance(doc.get(c), str) else None for c in ("record_id", "record_type")]
            misplaced = told[1] is not None and told[1] != kind
            rows.append((member.package, member.path, line, told[0], None if misplaced else told[1], text, MISPLACED if misplaced else None))
            size += len(raw)
            if size > BATCH_BYTES:
                yield self._rows(rows)
                rows, size = [], 0
        if rows:
            yield self._rows(rows)


class PushingRecordReader(Pushing, RecordReader):
    pass


# ---- writing


@dataclass
class Archives(WriterCommitMessage):
    """(temporary name, package) of each archive of a task."""

    written: list[tuple[str, str]]


class ArchiveWriter(DataSourceWriter):
    """A task writes each of its packages to a file of a name of its own; the job's commit gives them their names.

    The rows of a package come one after the other, sorted by path, as :func:`write_packages` deals them; the bytes depend on
    the files alone. Where a package is already there, or comes twice, nothing is committed.
    """

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite

    def write(self, iterator: Iterator[Row]) -> Archives:
        system, root = file_system(self.folder)
        system.create_dir(f"{root}/_writing", recursive=True)
        done: list[tuple[str, str]] = []
        archive: zipfile.ZipFile | None = None
        stream = None

        def close() -> None:
            if archive is not None:
                archive.close()
                stream.close()

        for row in iterator:
            if not done or done[-1][1] != row.package_id:
                close()
                name = f"{root}/_writing/{uuid.uuid4().hex}.zip"
                done.append((name, row.package_id))
                stream = system.open_output_stream(name)
                archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED, compresslevel=9)
            info = zipfile.ZipInfo(row.path, (1980, 1, 1, 0, 0, 0))
            info.external_attr, info.create_system, info.compress_type = 0o644 << 16, 3, zipfile.ZIP_DEFLATED
            archive.writestr(info, bytes(row.content))
        close()
        return Archives(done)

    def commit(self, messages: list[Archives | None]) -> None:
        system, root = file_system(self.folder)
        written = [w for m in messages if m for w in m.written]
        names = [f"{root}/{package}.zip" for _, package in written]
        there = [i.path for i in system.get_file_info(names) if i.type != fs.FileType.NotFound]
        if len(set(names)) < len(names) or (there and not self.overwrite):
            self.abort(messages)
            raise FileExistsError(f"packages are there already, or came twice: {sorted(there)[:5]}")
        for (temporary, _), name in zip(written, names):
            system.move(temporary, name)

    def abort(self, messages: list[Archives | None]) -> None:
        system, _ = file_system(self.folder)
        for m in messages:
            for temporary, _ in m.written if m else []:
                system.delete_file(temporary)


class PackageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "package_files"

    def schema(self) -> str:
        return "package_id string, path string, content binary, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushingFileReader if "push" in self.options else FileReader)(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(self.options["path"], overwrite)


class PackageRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "package_records"

    def schema(self) -> str:
        return "package_id string, path string, line long, record_id string, record_type string, json string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushingRecordReader if "push" in self.options else RecordReader)(dict(self.options))


@lru_cache(maxsize=8)
def _register(spark: SparkSession) -> None:
    for source in (PackageFiles, PackageRecords):
        spark.dataSource.register(source)


def _load(spark: SparkSession, kind: str, folder: str, limits: Limits, asked: dict[str, Sequence[str] | None], **more: str) -> DataFrame:
    _register(spark)
    options = {c: str(getattr(limits, c)) for c in ("members", "member_bytes", "total_bytes", "ratio")} | more
    options |= {f"{c}s": json.dumps(list(values)) for c, values in asked.items() if values is not None}
    return spark.read.format(kind).options(**options).load(folder)


def load_files(spark: SparkSession, folder: str, package_ids: Sequence[str] | None = None, paths: Sequence[str] | None = None, limits: Limits = Limits()) -> DataFrame:
    """Members of the archives of ``folder``; an archive that breaks a rule gives an error row and no files."""
    return _load(spark, "package_files", folder, limits, {"package_id": package_ids, "path": paths})


def load_records(spark: SparkSession, folder: str, package_ids: Sequence[str] | None = None, record_types: Sequence[str] | None = None, limits: Limits = Limits()) -> DataFrame:
    """Record lines of the archives of ``folder``, straight from the members; only members that can hold what is named are opened."""
    rows = _load(spark, "package_records", folder, limits, {"package_id": package_ids, "record_type": record_types})
    return rows if record_types is None else rows.filter(F.col("record_type").isin(*record_types))


def scan(spark: SparkSession, folder: str, condition: str, kind: str = "package_records", limits: Limits = Limits()) -> DataFrame:
    """The rows that fulfil ``condition``, which is pushed down to the archives, as a stored table.

    Spark plans a Python source once for each DataFrame and keeps the pruned members for whatever else is asked of it, so a
    DataFrame that takes filters must not be handed on.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return stored(_load(spark, kind, folder, limits, {}, push="true").filter(condition), "scanned")


def write_packages(files: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Write (package_id, path, content) as archives, all or none. A package's members pass through one task, one at a time."""
    _register(files.sparkSession)
    rows = files.select(F.col("package_id").cast("string").alias("package_id"), "path", "content")
    dealt = in_runs(rows, ["package_id"], "path")
    dealt.withColumn("error", F.lit(None).cast("string")).write.format("package_files").mode("overwrite" if overwrite else "append").save(folder)
