"""``python -m trussline``: validate, info, query, diff, context and gate over stores of packages.

A store is a folder of packages, or a pattern of ZIP archives. One JSON line a result row. Exit codes: 0 fine, 1 for a
semantic change or a gate that doesn't pass, 2 for invalid packages and errors.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trussline.functions.canon import canonical_json
from trussline.operators import context, gate, policy, query
from trussline.session import local_session
from trussline.sources import packages


def read_store(spark: SparkSession, store: str) -> DataFrame:
    return packages.read_archives(spark, store) if store.endswith(".zip") else packages.read_directories(spark, store)


def _print(rows: DataFrame) -> int:
    count = 0
    for line in rows.toJSON().toLocalIterator():
        print(line)
        count += 1
    return count


def context_sections(files: DataFrame, profile: str) -> DataFrame:
    """Sections of all packages' records with their place and size, to be packed."""
    from pyspark.sql import Window

    lines = packages.records(files)
    text = context.section(F.col("record_id"), F.col("record_type"), F.col("path"), F.col("line"), canonical_json("json"))
    order = F.row_number().over(Window.partitionBy("package_id").orderBy(context.priority(F.col("record_type"), profile), "record_id"))
    total = F.count("*").over(Window.partitionBy("package_id"))
    return lines.withColumns({"section": text, "place": order, "total": total}).withColumn("size", F.octet_length("section").cast("long"))


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="trussline")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, more in (("validate", []), ("info", []), ("query", ["expression"]), ("diff", ["after"]), ("context", []), ("gate", ["policy"])):
        p = commands.add_parser(name)
        p.add_argument("store")
        for x in more:
            p.add_argument(x)
        if name == "context":
            p.add_argument("--profile", default="agent", choices=["agent", "audit", "compact"])
            p.add_argument("--tokens", type=int, default=40_000)
            p.add_argument("--chunk-tokens", type=int, default=4_000)
        if name == "gate":
            p.add_argument("--baseline")
            p.add_argument("--annotations", action="store_true")
    a = parser.parse_args(args)
    spark = SparkSession.getActiveSession() or local_session()
    files = read_store(spark, a.store)
    wrong = packages.validate_packages(files)
    if a.command == "validate":
        return 2 if _print(wrong.orderBy("package_id", "path", "code")) else 0
    if _print(wrong.select("package_id", "code", "path")):
        return 2
    if a.command == "info":
        _print(query.package_info(packages.manifests(files)).orderBy("package_id"))
    elif a.command == "query":
        try:
            _print(query.run_query(packages.records(files), a.expression).select("package_id", "record_id", "json"))
        except query.QuerySyntaxError as error:
            print(error, file=sys.stderr)
            return 2
    elif a.command == "diff":
        return 1 if _print(policy.package_changes(files, read_store(spark, a.after)).orderBy("package_id", "category", "subject_id")) else 0
    elif a.command == "context":
        sections = context_sections(files, a.profile)
        heads = packages.manifests(files).select("package_id", "logical_digest", F.to_json("capabilities").alias("capabilities"), F.to_json("loss_summary").alias("losses"))
        _print(context.render(sections, heads, a.profile, context.Budget(a.tokens, a.chunk_tokens)).orderBy("package_id", "path"))
    else:
        try:
            with open(a.policy, encoding="utf-8") as f:
                loaded = policy.load_policy(f.read())
            verdicts, statuses, findings = policy.evaluate(spark, loaded, files, read_store(spark, a.baseline) if a.baseline else None)
        except policy.PolicyError as error:
            print(error, file=sys.stderr)
            return 2
        verdicts = verdicts.cache()
        _print(gate.annotations(verdicts, statuses, findings) if a.annotations else verdicts.orderBy("package_id"))
        return verdicts.agg(F.coalesce(F.max("exit_code"), F.lit(0))).first()[0]
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
