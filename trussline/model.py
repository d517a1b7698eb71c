"""Enumerations of the record model and their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the record model, in their natural order.
RECORD_TYPES = ("source", "primitive", "assertion", "entity", "relation", "diagnostic", "unsupported")
RECORD_FILES = {
    "sources/sources.jsonl": "source",
    "evidence/primitives.jsonl": "primitive",
    "evidence/assertions.jsonl": "assertion",
    "model/entities.jsonl": "entity",
    "model/relations.jsonl": "relation",
    "diagnostics/diagnostics.jsonl": "diagnostic",
}
REQUIRED_ARTIFACTS = (*RECORD_FILES, "context/index.md")
VALUE_STATES = ("known", "unknown", "not_applicable", "conflicted", "explicit_null", "unsupported")
SUPPORT_LEVELS = ("unsupported", "opaque", "partial", "full")
SEVERITIES = ("info", "warning", "error", "blocking")
STATUSES = ("pass", "waived", "requires_review", "fail", "error")
DERIVED_FIDELITY = ("converted", "tessellated", "rasterized", "projection_2d", "preview", "inferred")
FIDELITY = ("source_exact", "parametric", "brep", *DERIVED_FIDELITY)
#: Order of record types in a context; types not named come last.
CONTEXT_ORDER = {
    "agent": ("source", "entity", "relation", "diagnostic", "assertion", "primitive"),
    "compact": ("source", "entity", "relation", "diagnostic", "assertion", "primitive"),
    "audit": ("source", "diagnostic", "primitive", "assertion", "entity", "relation"),
}


def rank(value: Column, names: tuple[str, ...], other: int | None = None) -> Column:
    """Place of ``value`` among ``names``; ``other`` (null by default) for anything else."""
    place = F.array_position(F.array(*map(F.lit, names)), value)
    return F.when(place > 0, (place - 1).cast("int")).otherwise(F.lit(other).cast("int"))


def worst(status: Column) -> Column:
    """Aggregate: the status of the highest rank; ``pass`` for no rows."""
    return F.coalesce(F.max_by(status, rank(status, STATUSES)), F.lit("pass"))
