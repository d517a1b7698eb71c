"""Record lines as a stream: new files of a package store give the same rows that a batch read gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_records(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Streaming rows (file, record_id, record_type, json) of JSONL files as they come into ``folder``."""
    lines = spark.readStream.format("text").option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(folder)
    doc = F.try_parse_json("value")
    return lines.filter(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.try_variant_get(doc, "$.record_id", "string").alias("record_id"), F.try_variant_get(doc, "$.record_type", "string").alias("record_type"), F.col("value").alias("json"))


def stream_counts(records: DataFrame) -> DataFrame:
    """Running number of records of each type and severity; state is one row a pair."""
    severity = F.coalesce(F.try_variant_get(F.try_parse_json("json"), "$.severity", "string"), F.lit("none"))
    return records.groupBy("record_type", severity.alias("severity")).agg(F.count("*").alias("n"))


def keep_ingesting(records: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the stream to a Parquet table by record type; each file once, whatever fails between."""
    return records.writeStream.format("parquet").partitionBy("record_type").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
