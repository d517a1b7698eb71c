"""The one-predicate query language: ``type.path == JSON`` and ``type.path != JSON`` over record tables."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trussline.functions.canon import equality_key, key_of
from trussline.model import RECORD_TYPES

_GRAMMAR = re.compile(rf"(?P<kind>{'|'.join(RECORD_TYPES)}|record)\.(?P<path>[A-Za-z_][A-Za-z0-9_.]*)\s*(?P<op>==|!=)\s*(?P<literal>.+)")


class QuerySyntaxError(ValueError):
    """The expression is not of the grammar, or its literal is no JSON."""


@dataclass(frozen=True)
class Query:
    kind: str
    path: tuple[str, ...]
    negated: bool
    literal: object


def parse(expression: str) -> Query:
    match = _GRAMMAR.fullmatch(expression.strip())
    if not match:
        raise QuerySyntaxError("expected <record type>.<field> ==|!= <JSON literal>")
    try:
        literal = json.loads(match["literal"])
    except ValueError as error:
        raise QuerySyntaxError(f"the literal is no JSON: {error}") from error
    return Query(match["kind"], tuple(match["path"].split(".")), match["op"] == "!=", literal)


def at_path(document: Column, path: tuple[str, ...]) -> Column:
    """The variant at a path of object keys. SQL null if missing; a JSON null is a variant that is not SQL null."""
    return F.variant_get(document, "$" + "".join(f"['{part}']" for part in path), "variant")


def equals(document: Column, path: tuple[str, ...], literal: object) -> Column:
    """Whether the value at the path is there and equal, as deep equality where true, 1 and 1.0 are one."""
    value = at_path(document, path)
    text = F.to_json(value)
    if literal is None:
        found = text == "null"
    elif isinstance(literal, str):
        found = (F.schema_of_variant(value) == "STRING") & (F.try_variant_get(value, "$", "string") == literal)
    else:
        found = equality_key(text) == key_of(json.dumps(literal))
    return F.coalesce(found, F.lit(False))


def run_query(records: DataFrame, expression: str, document: str = "json") -> DataFrame:
    """Records that the expression selects, in order of their ids.

    ``records`` has record_id, record_type and the record as JSON text. ``!=`` is the negation of ``==``, so records
    without the path match it. Only records of the type are parsed: the filter on the type column reaches the scan.
    """
    q = parse(expression)
    kept = records if q.kind == "record" else records.filter(F.col("record_type") == q.kind)
    match = equals(F.parse_json(F.col(document)), q.path, q.literal)
    return kept.filter(~match if q.negated else match).orderBy("record_id")


def package_info(packages: DataFrame) -> DataFrame:
    """The manifest's summary columns."""
    return packages.select("package_id", "format_version", "created_at", "package_form", "source_embedding_policy", "logical_digest", "capabilities")


def resolve_terms(records: DataFrame, vocabulary: DataFrame, column: str = "term") -> DataFrame:
    """``records`` with the uri of their neutral term, null for terms that are not registered."""
    return records.join(vocabulary.select(F.col("term").alias(column), "uri"), column, "left")
