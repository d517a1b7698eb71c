"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from functools import cache

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def _own_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="trussline-")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see, as ``spark.checkpoint.dir`` names it.

    Where that is unset, a session that runs in one process (tests, one machine) gets a folder of its own; a cluster gets
    an error, as its executors would not see each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if re.fullmatch(r"local(\[.*\])?", context.master):
        return _own_dir(context.applicationId)
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share; intermediate tables are written there")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage, so that a table used by several jobs is computed once and a lost executor costs a reread.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_runs(df: DataFrame, keys: Sequence[str], *order: str | Column) -> DataFrame:
    """``df`` dealt by ``keys`` and sorted by them and ``order``, so that each key is one sorted run of one task.

    Rows are dealt by a hash of the keys. A repartition by the keys themselves is dropped where a join or grouping below
    has dealt by them before, and adaptive execution may read that one by its writers, or a large key in pieces.
    """
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def joined(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the input, merged on the executors.

    Tables of much alike rows are small as files and in a shuffle, so Spark takes them for small ones and has the driver
    unpack and send them.
    """
    return left.join(right.hint("merge"), on if isinstance(on, str) else list(on), how)


def drop_stored(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a folder, as tasks open it: local or shared folders, object stores, HDFS."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else fs.FileSystem.from_uri("file:///" + path.removeprefix("file:").lstrip("/"))
