"""Token ids in binary files: a Spark data source of patched frame-of-reference blocks with an index of block starts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from trussline.llm.byte_pieces import BYTE_BPE_PATH, byte_pieces
from trussline.llm.common import map_rows, shared_dir
from trussline.llm.packed_ids import BLOCK, pack_blocks, unpack_blocks

MAGIC = b"TOKPFOR1"
MANIFEST = "_manifest.json"
#: Blocks that a writer packs and a reader unpacks at a time.
AT_ONCE = 256
#: Ids of the documents that a reader hands over in one batch, about.
BATCH_IDS = 1 << 20
END_ID = 0
SCHEMA = "doc_id long, start long, ids binary"


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, as driver and executors open it (local or shared folders, object stores, HDFS)."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else fs.FileSystem.from_uri("file:/" + path.removeprefix("file:").lstrip("/"))


class FileWriter:
    """One file: magic, blocks, then block starts, document ids with their nulls, document ends, and a tail of sizes.

    Ids run on from document to document, so blocks don't end with them; only the index is kept in memory.
    """

    def __init__(self, stream):
        self.stream, self.at = stream, len(MAGIC)
        stream.write(MAGIC)
        self.open: list[np.ndarray] = []
        self.waiting = self.n_ids = 0
        self.starts: list[int] = []
        self.docs: list[int | None] = []
        self.ends: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.n_ids += len(ids)
        self.ends.append(self.n_ids)
        self.open.append(ids)
        self.waiting += len(ids)
        if self.waiting >= AT_ONCE * BLOCK:
            values = np.concatenate(self.open)
            whole = len(values) // BLOCK * BLOCK
            self._put(values[:whole])
            self.open, self.waiting = [values[whole:]], len(values) - whole

    def _put(self, values: np.ndarray) -> None:
        for at in range(0, len(values), AT_ONCE * BLOCK):
            for block in pack_blocks(values[at : at + AT_ONCE * BLOCK]):
                self.starts.append(self.at)
                self.stream.write(block)
                self.at += len(block)

    def finish(self) -> None:
        if self.open:
            self._put(np.concatenate(self.open))
        for index in (self.starts, [d or 0 for d in self.docs], self.ends):
            self.stream.write(np.array(index, "<i8").tobytes())
        self.stream.write(np.packbits(np.array([d is None for d in self.docs], bool), bitorder="little").tobytes())
        self.stream.write(np.array([self.at, len(self.starts), len(self.docs), self.n_ids], "<i8").tobytes() + MAGIC)


@dataclass
class FileIndex:
    blocks_end: int
    starts: np.ndarray
    docs: list[int | None]
    ends: np.ndarray


def read_index(source: pa.NativeFile, size: int) -> FileIndex:
    tail = 4 * 8 + len(MAGIC)
    source.seek(size - tail)
    data = source.read(tail)
    if data[-len(MAGIC) :] != MAGIC:
        raise ValueError("not a file of packed token ids, or cut short")
    blocks_end, n_blocks, n_docs, _ = np.frombuffer(data[:32], "<i8").tolist()
    source.seek(blocks_end)
    starts, docs, ends = (np.frombuffer(source.read(8 * n), "<i8") for n in (n_blocks, n_docs, n_docs))
    null = np.unpackbits(np.frombuffer(source.read((n_docs + 7) // 8), np.uint8), bitorder="little")[:n_docs].astype(bool)
    return FileIndex(blocks_end, starts, [None if lost else d for d, lost in zip(docs.tolist(), null)], ends)


def read_ids(source: pa.NativeFile, index: FileIndex, first: int, last: int) -> np.ndarray:
    """Ids ``first`` to before ``last`` of a file; only the blocks that hold them are read."""
    if first >= last:
        return np.zeros(0, np.uint32)
    out = []
    begin, end = first // BLOCK, -(-last // BLOCK)
    for at in range(begin, end, AT_ONCE):
        to = min(at + AT_ONCE, end)
        stop = int(index.starts[to]) if to < len(index.starts) else index.blocks_end
        source.seek(int(index.starts[at]))
        words = np.frombuffer(source.read(stop - int(index.starts[at])), "<u4")
        out.append(unpack_blocks(words, (index.starts[at:to] - index.starts[at]) // 4))
    return np.concatenate(out)[first - begin * BLOCK : last - begin * BLOCK]


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str | None
    docs: int
    ids: int


@dataclass
class Shard(InputPartition):
    file: str
    start: int
    value: object = field(default=None)


class TokenFiles(DataSource):
    """``token_files``: writes (doc_id long, ids binary, little-endian unsigned of ``bytes`` each) in the order of partitions and rows.

    Reading gives (doc_id, start, ids): ``start`` counts the ids of all documents before, ``ids`` are packed as unsigned 32 bit.
    A task writes a file under a name of its own; the job's commit lists the files of the tasks that count in a manifest,
    which is what readers go by, so lost and repeated tasks leave no trace in the result.
    """

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return TokenReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return TokenWriter(self.options["path"], int(self.options.get("bytes", "4")))


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, path: str, width: int):
        self.path, self.dtype = path.rstrip("/"), f"<u{width}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = place_of(self.path)
        partition, name, writer, stream = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.tok", None, None
        for batch in iterator:
            if batch.num_rows and writer is None:
                system.create_dir(root, recursive=True)
                stream = system.open_output_stream(f"{root}/{name}")
                writer = FileWriter(stream)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                writer.add(doc_id, np.frombuffer(ids.as_buffer(), self.dtype).astype(np.uint32))
        if writer is None:
            return Written(partition, None, 0, 0)
        writer.finish()
        stream.close()
        return Written(partition, name, len(writer.docs), writer.n_ids)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = place_of(self.path)
        files, start = [], 0
        for m in sorted((m for m in messages if m and m.file), key=lambda m: m.partition):
            files.append({"file": m.file, "start": start, "docs": m.docs, "ids": m.ids})
            start += m.ids
        system.create_dir(root, recursive=True)
        fresh = f"{root}/{MANIFEST}.{uuid.uuid4().hex}"
        with system.open_output_stream(fresh) as out:
            out.write(json.dumps({"block": BLOCK, "ids": start, "files": files}).encode())
        system.move(fresh, f"{root}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = place_of(self.path)
        for m in messages:
            if m and m.file:
                system.delete_file(f"{root}/{m.file}")


class TokenReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def partitions(self) -> list[Shard]:
        system, root = place_of(self.path)
        with system.open_input_stream(f"{root}/{MANIFEST}") as source:
            return [Shard(f["file"], f["start"]) for f in json.loads(source.read())["files"]]

    def read(self, partition: Shard | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        system, root = place_of(self.path)
        path = f"{root}/{partition.file}"
        with system.open_input_file(path) as source:
            index = read_index(source, system.get_file_info(path).size)
            begins = np.concatenate([[0], index.ends[:-1]])
            at = 0
            while at < len(index.docs):
                to = max(at + 1, int(np.searchsorted(index.ends, begins[at] + BATCH_IDS, "right")))
                ids = read_ids(source, index, int(begins[at]), int(index.ends[to - 1]))
                cuts = index.ends[at:to] - begins[at]
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(np.concatenate([[0], cuts]).astype("<i8") * 4), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([pa.array(index.docs[at:to], pa.int64()), pa.array(begins[at:to] + partition.start, pa.int64()), data.cast(pa.binary())], ["doc_id", "start", "ids"])
                at = to


@lru_cache(maxsize=8)
def _register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenFiles)


def encode_ids(docs: DataFrame, path: str = BYTE_BPE_PATH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids) of (doc_id, text): packed ids of each whole text, ``end_id`` behind them; rows keep their order in a partition."""

    def make():
        pieces = byte_pieces(path)
        end = np.array([end_id], pieces.dtype).tobytes()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [pieces.encode(text or "") + end for text in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

        return work

    return map_rows(docs.select("doc_id", "text"), "doc_id long, ids binary", make, rows=256)


def write_token_files(docs: DataFrame, target: str, path: str = BYTE_BPE_PATH, end_id: int = END_ID) -> None:
    """Write the ids of all texts to ``target`` in ascending order of doc_id.

    Documents are dealt by ranges of (doc_id, hash of the text, place), so neither a repeated id nor a repeated row
    fills one task; a task encodes its range in order and writes one file. Null ids come first, rows of one id by the XXH64 of their text;
    null texts are empty. Other columns don't matter.
    """
    _register(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    ranged = keyed.repartitionByRange(parts, "doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "place")
    width = byte_pieces(path).dtype.itemsize
    encode_ids(ranged, path, end_id).write.format("token_files").option("bytes", width).mode("append").save(target)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of the documents in the files."""
    _register(spark)
    return spark.read.format("token_files").load(path)


def token_file_report(docs: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, as read back from files in the shared folder.

    Every row counts, repeated ones too; an empty table gives an empty table.
    """
    target = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, target)
    found = read_token_files(docs.sparkSession, target)
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
