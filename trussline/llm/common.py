"""What the operators of this subpackage share: Arrow batches and fold tests, beside the intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trussline.storage import drop_stored, shared_dir, stored  # noqa: F401  the operators take them from here


def map_rows(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], rows: int = 512) -> DataFrame:
    """``mapInArrow`` in slices of at most ``rows`` rows.

    ``make`` runs once in each task and returns the function for a slice, so tables and caches are built per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield work(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def residue(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null keys give null."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def in_fold(key: Column, modulus: int, remainder: int) -> Column:
    """Whether the key falls in the fold; false for null keys."""
    return F.coalesce(residue(key, modulus) == remainder, F.lit(False))


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with underscores before it until no column of ``df`` is called so, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
