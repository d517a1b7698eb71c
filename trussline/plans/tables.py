"""The star schema, events and documents as tables of the record model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as diagnostics of the package of their user."""
    e = table(spark, sf_dir, "events")
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warning").otherwise("info")
    return e.select(
        F.col("user_id").alias("package_id"),
        F.format_string("diagnostic-%010d", "event_id").alias("record_id"),
        F.col("event_id").alias("line"),
        F.col("event_type").alias("code"),
        severity.alias("severity"),
        F.get_json_object("props", "$.k").cast("long").alias("affected_count"),
        "ts",
    )


def diagnostic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as record rows with their JSON; the count is under props.k, as a number."""
    e = table(spark, sf_dir, "events")
    body = F.to_json(F.struct(F.col("event_type").alias("code"), F.from_json("props", "k double").alias("props"), F.col("value"), (F.col("event_id") % 2 == 0).alias("even")))
    return e.select(F.format_string("diagnostic-%010d", "event_id").alias("record_id"), F.lit("diagnostic").alias("record_type"), body.alias("json"))


def entity_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entities: no segment where the balance is negative, a null one where it is below 1000."""
    c = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_acctbal") >= 1000, F.concat(F.lit('"'), "c_mktsegment", F.lit('"'))).otherwise("null")
    body = F.when(F.col("c_acctbal") < 0, F.format_string('{"label":"%s"}', "c_name")).otherwise(F.format_string('{"label":"%s","segment":{"name":%s}}', F.col("c_name"), name))
    return c.select(F.format_string("entity-%010d", "c_custkey").alias("record_id"), F.lit("entity").alias("record_type"), body.alias("json"))


def assertion_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order status as value states of the package of the customer: F known, O unknown, P conflicted; none for key % 97 = 0."""
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "known").when(F.col("o_orderstatus") == "O", "unknown").otherwise("conflicted")
    return o.select(F.col("o_custkey").alias("package_id"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"), F.lit("#value")).alias("subject"), (F.col("o_orderkey") % 97 != 0).alias("present"), state.alias("state"))


def order_revisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two revisions of the orders: the first lacks keys % 20 = 0, the second % 20 = 1 and has key % 13 = 0 changed."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("package_id"), "o_orderkey", F.col("o_orderstatus").alias("content"))
    changed = F.when(F.col("o_orderkey") % 13 == 0, F.concat("content", F.lit("*"))).otherwise(F.col("content"))
    return o.filter("o_orderkey % 20 <> 0"), o.filter("o_orderkey % 20 <> 1").withColumn("content", changed)


def capability_levels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Levels of nations by their suppliers, in two revisions: two capabilities, suppliers in all and those in credit."""
    s = table(spark, sf_dir, "supplier")
    level = lambda n: F.when(n >= 6, "full").when(n >= 4, "partial").when(n >= 2, "opaque").otherwise("unsupported")

    def of(rows: DataFrame) -> DataFrame:
        n = rows.groupBy(F.col("s_nationkey").alias("package_id")).agg(F.count("*").alias("all"), F.count_if(F.col("s_acctbal") > 0).alias("credit"))
        return n.select("package_id", F.expr("stack(2, 'suppliers', `all`, 'credit', credit) as (capability, n)")).select("package_id", "capability", level(F.col("n")).alias("level"))

    return of(s), of(s.filter("s_suppkey % 5 <> 0"))
