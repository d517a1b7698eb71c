"""Revision diffs: keyed full outer joins of record tables, inventories and maps, for many pairs of packages at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.model import RECORD_FILES, SUPPORT_LEVELS, rank

CATEGORIES = ("added_records", "removed_records", "changed_records", "artifact_changes", "capability_regressions", "loss_changes", "identity_changes", "producer_changes", "version_changes")


def diff_records(before: DataFrame, after: DataFrame, keys: list[str], content: str) -> DataFrame:
    """(keys, status) of rows that were added, removed or changed. ``content`` is compared as it is: pass equality keys."""
    old = before.select(*keys, F.col(content).alias("__old"), F.lit(True).alias("__was"))
    new = after.select(*keys, F.col(content).alias("__new"), F.lit(True).alias("__is"))
    status = F.when(F.col("__was").isNull(), "added").when(F.col("__is").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    return old.join(new, keys, "full_outer").select(*keys, status.alias("status")).filter("status is not null")


def diff_maps(before: DataFrame, after: DataFrame, keys: list[str], entry: str, value: str) -> DataFrame:
    """(keys, entry, before, after) of map entries that differ; a missing entry counts as null on its side."""
    old = before.select(*keys, entry, F.col(value).alias("before"))
    new = after.select(*keys, entry, F.col(value).alias("after"))
    return old.join(new, [*keys, entry], "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))


def diff_inventories(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Changed artifacts of inventories (keys, path, sha256, authoritative), told apart by ``is_authoritative``.

    An authoritative change is one of sha256 or of the flag, on a path that either side marks and that is no record file.
    """
    old = before.select(*keys, "path", F.col("sha256").alias("before"), F.coalesce("authoritative", F.lit(False)).alias("was"))
    new = after.select(*keys, "path", F.col("sha256").alias("after"), F.coalesce("authoritative", F.lit(False)).alias("is"))
    both = old.join(new, [*keys, "path"], "full_outer").withColumns({"was": F.coalesce("was", F.lit(False)), "is": F.coalesce("is", F.lit(False))})
    changed = ~F.col("before").eqNullSafe(F.col("after"))
    marked = (F.col("was") | F.col("is")) & ~F.col("path").isin(*RECORD_FILES)
    return both.filter(changed | (marked & (F.col("was") != F.col("is")))).select(*keys, "path", "before", "after", marked.alias("is_authoritative"), changed.alias("sha_changed"))


def capability_regressions(changes: DataFrame) -> DataFrame:
    """Entries of :func:`diff_maps` over support levels that got worse or went away."""
    was, now = rank(F.col("before"), SUPPORT_LEVELS), rank(F.col("after"), SUPPORT_LEVELS)
    return changes.filter(was.isNotNull() & (F.col("after").isNull() | (now < was)))


def category_counts(changes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_added, n_removed, n_changed, semantic_change) from the rows of :func:`diff_records`."""
    count = lambda status: F.sum((F.col("status") == status).cast("long"))
    out = changes.groupBy(*keys).agg(count("added").alias("n_added"), count("removed").alias("n_removed"), count("changed").alias("n_changed"))
    return out.withColumn("semantic_change", F.col("n_added") + F.col("n_removed") + F.col("n_changed") > 0)
