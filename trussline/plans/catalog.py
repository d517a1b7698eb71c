"""The registered queries over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trussline.functions import canon, values
from trussline.model import SUPPORT_LEVELS, rank, worst
from trussline.operators import context, datum, diff, drawings, gate, geometry, graph, inference, policy, providers, query, subdivision, trust, validate
from trussline.plans.tables import assertion_states, capability_levels, diagnostic_records, diagnostics, entity_records, order_revisions, table
from trussline.sources import curve_samples, dxf_geometry, ifc_model, ifc_plane, package_store, packages, rasters, scanners
from trussline.storage import shared_dir, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_DIAG = """
diag AS (SELECT user_id AS package_id, printf('diagnostic-%010d', event_id) AS record_id, event_id AS line, event_type AS code,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS severity,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS affected_count, ts FROM events)"""


# ---- query language


@register("SELECT printf('diagnostic-%010d', event_id) AS record_id FROM events WHERE event_type = 'error'")
def query_eq(spark, d):
    return query.run_query(diagnostic_records(spark, d), 'diagnostic.code == "error"').select("record_id")


@register("SELECT printf('diagnostic-%010d', event_id) AS record_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 69")
def query_eq_number(spark, d):
    return query.run_query(diagnostic_records(spark, d), "diagnostic.props.k == 69").select("record_id")


@register("SELECT printf('diagnostic-%010d', event_id) AS record_id FROM events WHERE event_id % 2 = 0")
def query_eq_bool_as_number(spark, d):
    return query.run_query(diagnostic_records(spark, d), "record.even == 1").select("record_id")


@register("SELECT printf('entity-%010d', c_custkey) AS record_id FROM customer WHERE c_acctbal < 1000 OR c_mktsegment <> 'BUILDING'")
def query_neq_missing(spark, d):
    return query.run_query(entity_records(spark, d), 'entity.segment.name != "BUILDING"').select("record_id")


@register("SELECT printf('entity-%010d', c_custkey) AS record_id FROM customer WHERE c_acctbal >= 0 AND c_acctbal < 1000")
def query_eq_null(spark, d):
    return query.run_query(entity_records(spark, d), "entity.segment.name == null").select("record_id")


@register("SELECT printf('entity-%010d', c_custkey) AS record_id FROM customer WHERE c_acctbal >= 1000 AND c_mktsegment = 'MACHINERY'")
def query_eq_object(spark, d):
    return query.run_query(entity_records(spark, d), 'entity.segment == {"name": "MACHINERY"}').select("record_id")


@register("SELECT record_id FROM (SELECT printf('entity-%010d', c_custkey) AS record_id FROM customer) WHERE false")
def query_other_type(spark, d):
    return query.run_query(entity_records(spark, d), 'relation.label == "x"').select("record_id")


@register("SELECT e.event_type AS term, v.uri, count(*) AS n FROM events e LEFT JOIN (VALUES ('error', 'urn:term:error'), ('view', 'urn:term:view')) v(term, uri) ON v.term = e.event_type GROUP BY 1, 2")
def vocab_resolve(spark, d):
    words = spark.createDataFrame([("error", "urn:term:error"), ("view", "urn:term:view")], "term string, uri string")
    seen = table(spark, d, "events").groupBy(F.col("event_type").alias("term")).agg(F.count("*").alias("n"))
    return query.resolve_terms(seen, words).select("term", "uri", "n")


# ---- value states and validation


@register("""SELECT CASE WHEN l.doc_id IS NOT NULL THEN 'known' ELSE 'unknown' END AS state, CASE WHEN l.doc_id IS NULL AND d.lang IS NULL THEN 'VALUE_STATE_REASON_REQUIRED' END AS code, count(*) AS n, sum(d.n_chars)::BIGINT AS chars
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY 1, 2""")
def value_state_scan(spark, d):
    labelled = table(spark, d, "labels").select("doc_id", F.lit("known").alias("state")).distinct()
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang").join(labelled, "doc_id", "left").withColumn("state", F.coalesce("state", F.lit("unknown")))
    code = values.value_state_error(F.col("state"), F.col("state") == "known", F.col("lang"))
    return docs.groupBy("state", code.alias("code")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@register("""SELECT code, count(*) AS n FROM (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'VALUE_STATE_INVALID' WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'VALUE_STATE_VALUE_REQUIRED'
WHEN o_orderstatus <> 'F' AND o_orderkey % 5 = 0 THEN 'VALUE_STATE_REASON_REQUIRED' WHEN o_orderstatus <> 'F' AND o_orderkey % 3 <> 0 THEN 'VALUE_STATE_VALUE_FORBIDDEN' END AS code FROM orders) GROUP BY 1""")
def value_state_rules(spark, d):
    o = table(spark, d, "orders")
    state = F.when(F.col("o_orderpriority") == "1-URGENT", "other").when(F.col("o_orderstatus") == "F", "known").otherwise("unknown")
    reason = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("NOT_MEASURED")
    return o.select(values.value_state_error(state, F.col("o_orderkey") % 3 != 0, reason).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@register("""WITH c AS (SELECT 'c' || c_custkey || CASE WHEN c_custkey % 4 = 0 THEN '/x' WHEN c_custkey % 4 = 1 THEN '/../x' WHEN c_custkey % 4 = 2 THEN '//x' ELSE chr(92) || 'x' END AS p, c_custkey FROM customer)
SELECT c_custkey % 4 AS form, count(*) FILTER (c_custkey % 4 = 0) AS safe, count(*) AS n FROM c GROUP BY 1""")
def safe_paths(spark, d):
    c = table(spark, d, "customer")
    form = F.col("c_custkey") % 4
    path = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.when(form == 0, "/x").when(form == 1, "/../x").when(form == 2, "//x").otherwise("\\x"))
    return c.groupBy(form.alias("form")).agg(F.count_if(values.safe_path(path)).alias("safe"), F.count("*").alias("n"))


def _lines(li, record_id, line):
    """Order lines as record lines of the package of their order, in one file."""
    return li.select(F.col("l_orderkey").alias("package_id"), F.lit("records/entities.jsonl").alias("path"), line.alias("line"), record_id.alias("record_id"), F.lit("entity").alias("record_type"), F.lit("{}").alias("json"))


@register("""WITH l AS (SELECT l_orderkey, l_suppkey, lag(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS before FROM lineitem)
SELECT l_orderkey, count(*) AS n FROM l WHERE l_suppkey < before GROUP BY 1""")
def order_violation(spark, d):
    line = (F.col("l_linenumber").cast("long") * 10**8 + F.col("l_partkey")) * 10**7 + F.col("l_suppkey")
    found = validate.check_records(_lines(table(spark, d, "lineitem"), F.format_string("entity-%010d", F.col("l_suppkey").cast("long")), line))
    return found.filter("code = 'RECORD_ORDER_INVALID'").groupBy(F.col("package_id").alias("l_orderkey")).agg(F.count("*").alias("n"))


@register("""WITH l AS (SELECT l_orderkey, l_linenumber, (l_partkey * 10000000 + l_suppkey) * 1000 + l_quantity::BIGINT AS line FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY line) AS nth FROM l)
SELECT l_orderkey, 'records/entities.jsonl:' || line AS path FROM n WHERE nth > 1""")
def dup_ids(spark, d):
    line = (F.col("l_partkey").cast("long") * 10**7 + F.col("l_suppkey")) * 1000 + F.col("l_quantity").cast("long")
    found = validate.check_records(_lines(table(spark, d, "lineitem"), F.format_string("entity-%d", F.col("l_linenumber").cast("long")), line))
    return found.filter("code = 'RECORD_ID_DUPLICATE'").select(F.col("package_id").alias("l_orderkey"), "path")


@register("""WITH e AS (SELECT user_id, event_id // 100 AS sequence, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events)
SELECT user_id, 'EVENT_SEQUENCE_INVALID' AS code, 'r' || user_id || '#' || min(place) AS path FROM e WHERE sequence <> place GROUP BY 1""")
def sequence_gap(spark, d):
    response = F.concat(F.lit("r"), F.col("user_id").cast("string"))
    events = table(spark, d, "events").select(F.col("user_id").alias("package_id"), response.alias("response_id"), F.floor(F.col("event_id") / 100).alias("sequence"))
    return validate.check_provider_events(events).withColumnRenamed("package_id", "user_id")


# ---- rules of manifests and records


@register("""WITH p AS (SELECT c_custkey AS package_id, c_custkey % 7 = 0 AS old, c_custkey % 5 = 0 AS form, c_custkey % 3 = 0 AS policy, c_custkey % 11 = 0 AS ext, c_custkey % 13 = 0 AS digest FROM customer)
SELECT package_id, 'VERSION_UNSUPPORTED' AS code, 'manifest.json#/version' AS path FROM p WHERE old UNION ALL SELECT package_id, 'REQUIRED_EXTENSION_UNSUPPORTED', 'manifest.json#/required_extensions' FROM p WHERE ext
UNION ALL SELECT package_id, 'SCHEMA_INVALID', 'manifest.json#/package_form' FROM p WHERE form AND NOT old UNION ALL SELECT package_id, 'SCHEMA_INVALID', 'manifest.json#/source_embedding_policy' FROM p WHERE policy AND NOT old
UNION ALL SELECT package_id, 'SCHEMA_INVALID', 'manifest.json#/logical_digest' FROM p WHERE digest AND NOT old""")
def manifest_rules(spark, d):
    k = F.col("c_custkey")
    packages = table(spark, d, "customer").select(
        k.alias("package_id"),
        F.when(k % 7 == 0, "9.0.0").otherwise("0.2.0").alias("format_version"),
        F.when(k % 13 == 0, "x").otherwise(F.sha2("c_name", 256)).alias("logical_digest"),
        F.when(k % 5 == 0, "tar").otherwise("zip").alias("package_form"),
        F.when(k % 3 == 0, "copied").otherwise("external").alias("source_embedding_policy"),
        F.when(k % 11 == 0, F.array(F.lit("x.y"))).otherwise(F.array().cast("array<string>")).alias("required_extensions"),
    )
    return validate.check_manifests(packages)


@register("""WITH said AS (SELECT o_custkey AS package_id, sha256(string_agg(line, '' ORDER BY line)) AS digest FROM (SELECT o_custkey, 'orders/' || o_orderkey || chr(0) || sha256(o_orderstatus) || chr(0) || o_orderkey || chr(10) AS line FROM orders) GROUP BY 1)
SELECT package_id, 'LOGICAL_DIGEST_MISMATCH' AS code, 'manifest.json#/logical_digest' AS path FROM said WHERE package_id % 9 = 0""")
def digest_check(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("package_id"), F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("path"), F.sha2("o_orderstatus", 256).alias("sha256"), F.col("o_orderkey").alias("bytes"))
    digests = validate.logical_digests(o, o)
    packages = digests.select("package_id", F.when(F.col("package_id") % 9 == 0, "0").otherwise(F.col("logical_digest")).alias("logical_digest"))
    return validate.check_digests(packages, digests)


@register("""WITH o AS (SELECT *, o_orderkey % 12 AS k FROM orders)
SELECT o_custkey AS package_id, CASE k WHEN 0 THEN 'INFERENCE_DIGEST_INVALID' WHEN 1 THEN 'INFERENCE_CONFIDENCE_INVALID' WHEN 2 THEN 'INFERENCE_REPRODUCIBILITY_INVALID' WHEN 3 THEN 'INFERENCE_PROVIDER_INVALID' WHEN 4 THEN 'INFERENCE_EXECUTION_MODE_INVALID'
WHEN 5 THEN 'INFERENCE_VERIFICATION_INVALID' WHEN 6 THEN 'FIDELITY_CLASS_INVALID' WHEN 7 THEN 'FIDELITY_DERIVATION_INVALID' WHEN 8 THEN 'ATTESTATION_DIGEST_INVALID' WHEN 9 THEN 'ATTESTATION_NETWORK_INVALID' ELSE 'COORDINATE_STRUCTURE_INVALID' END AS code,
'records/primitives.jsonl:' || o_orderkey AS path FROM o WHERE k < 11""")
def evidence_rules(spark, d):
    key, sha = F.col("o_orderkey"), F.sha2("o_orderstatus", 256)
    k = key % 12
    inference_ = '{"inference":{"input_artifact_sha256":"%s","input_region_sha256":"%s","request_digest":"%s","response_digest":"%s","extraction_confidence":%s,"interpretation_confidence":0.5,"reproducibility":"%s","provider_id":"%s","provider_version":"1","execution_mode":"%s","verification_state":"%s"}}'
    word = lambda at, bad, good: F.when(k == at, bad).otherwise(good)
    inferred = F.format_string(inference_, word(0, F.lit("x"), sha), sha, sha, sha, word(1, "1.5", "1"), word(2, "odd", "seeded"), word(3, "", "p"), word(4, "cloud", "local"), word(5, "maybe", "verified"))
    fidelity = F.format_string('{"representation_fidelity":{"class":"%s","derived":%s,"source_representation_ids":["a"]}}', word(6, "odd", "tessellated"), word(7, "false", "true"))
    attested = F.format_string('{"provider_attestation":{"deterministic":true,"request_digest":"%s","response_digest":"%s","execution_mode":"network","network_mode":"%s","provider_id":"p"}}', word(8, F.lit("x"), sha), sha, word(9, "disabled", "allowlisted"))
    doc = F.when(k.isin(6, 7), fidelity).when(k.isin(8, 9), attested).when(k == 10, '{"coordinate_qualification":{"global_location":{"state":"known"}}}').otherwise(inferred)
    records = table(spark, d, "orders").select(F.col("o_custkey").alias("package_id"), F.lit("records/primitives.jsonl").alias("path"), key.alias("line"), doc.alias("json"))
    return validate.check_evidence(records)


@register("""WITH inv AS (SELECT o_custkey AS package_id, 'o/' || o_orderkey AS path, sha256(o_orderstatus) AS sha256, o_orderkey AS bytes FROM orders WHERE o_orderkey % 11 <> 0),
files AS (SELECT o_custkey AS package_id, 'o/' || o_orderkey AS path, sha256(CASE WHEN o_orderkey % 17 = 0 THEN 'x' ELSE o_orderstatus END) AS sha256, o_orderkey + CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END AS bytes FROM orders WHERE o_orderkey % 7 <> 0)
SELECT 'ARTIFACT_MISSING' AS code, count(*) AS n FROM inv ANTI JOIN files USING (package_id, path)
UNION ALL SELECT 'ARTIFACT_SIZE_MISMATCH', count(*) FROM inv JOIN files USING (package_id, path) WHERE inv.bytes <> files.bytes
UNION ALL SELECT 'ARTIFACT_HASH_MISMATCH', count(*) FROM inv JOIN files USING (package_id, path) WHERE inv.sha256 <> files.sha256
UNION ALL SELECT 'REQUIRED_ARTIFACT_MISSING', 7 * count(DISTINCT package_id) FROM inv""")
def inventory_check(spark, d):
    from trussline.operators.validate import check_inventory

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("package_id"), F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("path"), "o_orderkey", "o_orderstatus")
    inv = o.filter("o_orderkey % 11 <> 0").select("package_id", F.col("o_orderkey").alias("place"), "path", F.sha2("o_orderstatus", 256).alias("sha256"), F.col("o_orderkey").alias("bytes"))
    content = F.when(F.col("o_orderkey") % 17 == 0, "x").otherwise(F.col("o_orderstatus"))
    files = o.filter("o_orderkey % 7 <> 0").select("package_id", "path", F.sha2(content, 256).alias("sha256"), (F.col("o_orderkey") + F.when(F.col("o_orderkey") % 19 == 0, 1).otherwise(0)).alias("bytes"))
    return check_inventory(inv, files, inv.select("package_id").distinct()).groupBy("code").agg(F.count("*").alias("n"))


# ---- diff


_REVISIONS = """b AS (SELECT o_custkey AS package_id, o_orderkey, o_orderstatus AS content FROM orders WHERE o_orderkey % 20 <> 0),
a AS (SELECT o_custkey AS package_id, o_orderkey, o_orderstatus || CASE WHEN o_orderkey % 13 = 0 THEN '*' ELSE '' END AS content FROM orders WHERE o_orderkey % 20 <> 1),
changes AS (SELECT coalesce(b.package_id, a.package_id) AS package_id, coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey,
  CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'removed' WHEN a.content <> b.content THEN 'changed' END AS status
  FROM b FULL JOIN a ON a.package_id = b.package_id AND a.o_orderkey = b.o_orderkey)"""


@register(f"WITH {_REVISIONS} SELECT * FROM changes WHERE status IS NOT NULL")
def diff_records(spark, d):
    return diff.diff_records(*order_revisions(spark, d), ["package_id", "o_orderkey"], "content")


@register(f"""WITH {_REVISIONS} SELECT package_id, count(*) FILTER (status = 'added') AS n_added, count(*) FILTER (status = 'removed') AS n_removed,
count(*) FILTER (status = 'changed') AS n_changed, true AS semantic_change FROM changes WHERE status IS NOT NULL GROUP BY 1""")
def diff_categories(spark, d):
    return diff.category_counts(diff_records(spark, d), ["package_id"])


_LEVELS = """lv AS (SELECT * FROM (VALUES (0, 'unsupported'), (1, 'opaque'), (2, 'partial'), (3, 'full')) t(r, level)),
caps AS (SELECT rev, package_id, capability, CASE WHEN n >= 6 THEN 'full' WHEN n >= 4 THEN 'partial' WHEN n >= 2 THEN 'opaque' ELSE 'unsupported' END AS level FROM (
  SELECT rev, s_nationkey AS package_id, capability, CASE capability WHEN 'suppliers' THEN count(*) ELSE count(*) FILTER (s_acctbal > 0) END AS n
  FROM supplier, (VALUES ('suppliers'), ('credit')) c(capability), (VALUES (1), (2)) r(rev) WHERE rev = 1 OR s_suppkey % 5 <> 0 GROUP BY rev, s_nationkey, capability))"""
_LEVEL_DIFF = f"""{_LEVELS}, changed AS (SELECT package_id, capability, b.level AS before, a.level AS after FROM (SELECT * FROM caps WHERE rev = 1) b FULL JOIN (SELECT * FROM caps WHERE rev = 2) a
USING (package_id, capability) WHERE b.level IS DISTINCT FROM a.level)"""


@register(f"WITH {_LEVEL_DIFF} SELECT * FROM changed")
def diff_map(spark, d):
    return diff.diff_maps(*capability_levels(spark, d), ["package_id"], "capability", "level")


@register(f"WITH {_LEVEL_DIFF} SELECT c.* FROM changed c JOIN lv b ON b.level = c.before LEFT JOIN lv a ON a.level = c.after WHERE a.r IS NULL OR a.r < b.r")
def capability_regression(spark, d):
    return diff.capability_regressions(diff_map(spark, d))


@register("""WITH b AS (SELECT p_partkey AS path, p_brand AS sha256, p_size % 2 = 0 AS f FROM part WHERE p_partkey % 10 <> 0), a AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 6 = 0 THEN p_type ELSE p_brand END AS sha256, p_size % 3 = 0 AS f FROM part WHERE p_partkey % 10 <> 1),
j AS (SELECT b.sha256 AS before, a.sha256 AS after, coalesce(b.f, false) AS bf, coalesce(a.f, false) AS af FROM b FULL JOIN a ON a.path = b.path)
SELECT (bf OR af) AS is_authoritative, before IS DISTINCT FROM after AS sha_changed, count(*) AS n FROM j WHERE before IS DISTINCT FROM after OR ((bf OR af) AND bf <> af) GROUP BY 1, 2""")
def diff_artifacts(spark, d):
    p = table(spark, d, "part")
    path = F.col("p_partkey").cast("string").alias("path")
    old = p.filter("p_partkey % 10 <> 0").select(F.lit(1).alias("package_id"), path, F.col("p_brand").alias("sha256"), (F.col("p_size") % 2 == 0).alias("authoritative"))
    new = p.filter("p_partkey % 10 <> 1").select(F.lit(1).alias("package_id"), path, F.when(F.col("p_partkey") % 6 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("sha256"), (F.col("p_size") % 3 == 0).alias("authoritative"))
    return diff.diff_inventories(old, new, ["package_id"]).groupBy("is_authoritative", "sha_changed").agg(F.count("*").alias("n"))


# ---- gate


@register(f"""WITH {_DIAG}, s AS (SELECT package_id, code, sum(affected_count)::BIGINT AS affected FROM diag GROUP BY 1, 2),
m AS (SELECT * FROM (VALUES ('click', 900), ('view', 1000), ('error', 500), ('purchase', 400)) t(code, maximum))
SELECT package_id, 'LOSS_MAXIMUM_EXCEEDED' AS code, 'loss.total' AS subject_id, sum(affected)::VARCHAR AS observed_state, 'fail' AS disposition FROM s GROUP BY 1 HAVING sum(affected) > 3500
UNION ALL SELECT package_id, 'LOSS_REASON_MAXIMUM_EXCEEDED', s.code, affected::VARCHAR, 'fail' FROM s LEFT JOIN m ON m.code = s.code WHERE maximum IS NULL OR affected > maximum
UNION ALL SELECT DISTINCT package_id, 'LOSS_EVIDENCE_MISSING', 'geometry', 'missing', 'fail' FROM diag""")
def loss_budget(spark, d):
    diag = diagnostics(spark, d)
    maxima = spark.createDataFrame([("click", 900), ("view", 1000), ("error", 500), ("purchase", 400)], "reason string, maximum long")
    declared = diag.select("package_id", F.col("code").alias("reason")).union(diag.select("package_id", F.lit("geometry"))).distinct()
    return gate.loss_maximum(declared, diag, 3500, maxima).drop("check_id")


@register(f"""WITH {_DIAG}, c AS (SELECT package_id, code, count(*) AS n FROM diag WHERE severity <> 'info' GROUP BY 1, 2)
SELECT package_id, 'DIAGNOSTIC_MAXIMUM_EXCEEDED' AS code, 'diagnostics.total' AS subject_id, sum(n)::VARCHAR AS observed_state, 'requires_review' AS disposition FROM c GROUP BY 1 HAVING sum(n) > 30
UNION ALL SELECT package_id, 'DIAGNOSTIC_CODE_MAXIMUM_EXCEEDED', code, n::VARCHAR, 'requires_review' FROM c WHERE code = 'error' AND n > 14""")
def diag_budget(spark, d):
    maxima = spark.createDataFrame([("error", 14), ("click", 1)], "code string, maximum long")
    return gate.diagnostic_maximum(diagnostics(spark, d), "warning", 30, maxima, on_fail="requires_review").drop("check_id")


@register(f"""WITH {_LEVELS}, m AS (SELECT * FROM (VALUES ('suppliers', 'partial'), ('credit', 'full'), ('export', 'opaque')) t(capability, minimum)), p AS (SELECT n_nationkey AS package_id FROM nation)
SELECT p.package_id, CASE WHEN c.level IS NULL THEN 'CAPABILITY_MISSING' ELSE 'CAPABILITY_BELOW_MINIMUM' END AS code, m.capability AS subject_id, coalesce(c.level, 'missing') AS observed_state, 'fail' AS disposition
FROM p CROSS JOIN m LEFT JOIN (SELECT * FROM caps WHERE rev = 1) c ON c.package_id = p.package_id AND c.capability = m.capability LEFT JOIN lv a ON a.level = c.level JOIN lv b ON b.level = m.minimum WHERE a.r IS NULL OR a.r < b.r""")
def capability_minimum(spark, d):
    minima = {"suppliers": "partial", "credit": "full", "export": "opaque"}
    packages = table(spark, d, "nation").select(F.col("n_nationkey").alias("package_id"))
    return gate.capability_minimum(capability_levels(spark, d)[0], minima, packages).drop("check_id")


_STATE_FINDINGS = """st AS (SELECT o_custkey AS package_id, 'order-' || o_orderkey || '#value' AS subject_id, o_orderkey % 97 <> 0 AS present, CASE o_orderstatus WHEN 'F' THEN 'known' WHEN 'O' THEN 'unknown' ELSE 'conflicted' END AS state FROM orders),
sf AS (SELECT package_id, 'VALUE_FIELD_MISSING' AS code, subject_id, 'missing' AS observed_state, 'fail' AS disposition FROM st WHERE NOT present
UNION ALL SELECT package_id, 'VALUE_STATE_REQUIRES_REVIEW', subject_id, state, 'requires_review' FROM st WHERE present AND state = 'unknown' UNION ALL SELECT package_id, 'VALUE_STATE_FAILED', subject_id, state, 'fail' FROM st WHERE present AND state = 'conflicted')"""


def _state_findings(spark, d):
    return gate.value_state_action(assertion_states(spark, d), {"unknown": "requires_review", "conflicted": "fail", "not_applicable": "allow"})


@register(f"WITH {_STATE_FINDINGS} SELECT * FROM sf")
def value_state_action(spark, d):
    return _state_findings(spark, d).drop("check_id")


@register(f"""WITH {_STATE_FINDINGS} SELECT package_id, code, subject_id, sha256('{{"check_id":"values","code":"' || code || '","evidence_refs":["' || subject_id || '"],"observed_state":"' || observed_state || '","subject_id":"' || subject_id || '"}}' || chr(10)) AS fingerprint FROM sf""")
def finding_fingerprint(spark, d):
    return gate.with_fingerprints(_state_findings(spark, d)).select("package_id", "code", "subject_id", "fingerprint")


@register("""SELECT page_id, sha256('{"check_id":"pages","code":"TEXT","evidence_refs":["a","b' || page_id || '"],"observed_state":"known","subject_id":' || to_json(nfc_normalize(html))::VARCHAR || '}' || chr(10)) AS fingerprint FROM pages WHERE html <> ''""")
def page_fingerprints(spark, d):
    """Whole pages as subjects of findings, with their line ends, quotes and accents."""
    refs = F.array(F.concat(F.lit("b"), F.col("page_id").cast("string")), F.lit("a"), F.lit("a"))
    pages = table(spark, d, "pages").filter("html <> ''")
    return pages.select("page_id", canon.fingerprint(F.lit("pages"), F.lit("TEXT"), F.col("html"), F.lit("known"), refs).alias("fingerprint"))


@register(f"""WITH {_STATE_FINDINGS}, n AS (SELECT package_id, count(*) AS c FROM sf GROUP BY 1) SELECT package_id, code, subject_id, observed_state, disposition FROM sf WHERE package_id NOT IN (SELECT package_id FROM n WHERE c > 9)
UNION ALL SELECT package_id, 'FINDINGS_LIMIT_EXCEEDED', 'findings', c::VARCHAR, 'error' FROM n WHERE c > 9""")
def findings_limit(spark, d):
    """Findings of the packages that have no more than nine; the others have one error each."""
    found = policy.within_limit(gate.with_fingerprints(_state_findings(spark, d)), 9)
    return found.select("package_id", "code", "subject_id", "observed_state", "disposition")


@register(f"""WITH {_STATE_FINDINGS}, v AS (SELECT package_id, CASE WHEN bool_or(disposition = 'fail') THEN 'fail' ELSE 'requires_review' END AS outcome FROM sf GROUP BY 1)
SELECT package_id, 0::BIGINT AS place, '# Delivery gate' || chr(10) || chr(10) || 'Outcome: `' || outcome || '` (exit `1`)' || chr(10) AS line FROM v
UNION ALL SELECT package_id, row_number() OVER (PARTITION BY package_id ORDER BY code, subject_id, observed_state, disposition), '    {{"check_id":"values","code":"' || code || '","subject_id":"' || subject_id || '","observed_state":"' || observed_state || '","disposition":"' || disposition || '"}}' FROM sf""")
def gate_markdown(spark, d):
    found = _state_findings(spark, d)
    statuses = found.select("package_id", "check_id", F.col("disposition").alias("status"))
    return gate.markdown(gate.outcomes(statuses, found), found)


@register("""SELECT s_suppkey::VARCHAR AS package_id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE '0.2.0' END AS format_version, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE '2024-01-01T00:00:00Z' END AS created_at, 'directory' AS package_form, 'external' AS source_embedding_policy, sha256(s_name) AS logical_digest, CASE WHEN s_nationkey % 2 = 0 THEN 'full' ELSE 'partial' END AS mesh FROM supplier""")
def package_info(spark, d):
    """Suppliers as manifests; what the command for information shows."""
    k = F.col("s_suppkey")
    version = F.when(k % 3 == 0, "").otherwise('"spec_version":"0.2.0",')
    moment = F.when(k % 4 == 0, "").otherwise('"created_at":"2024-01-01T00:00:00Z",')
    mesh = F.when(F.col("s_nationkey") % 2 == 0, "full").otherwise("partial")
    body = F.concat(F.lit("{"), version, moment, F.lit('"package_form":"directory","source_embedding_policy":"external","capabilities":{"mesh":"'), mesh, F.lit('"},"logical_digest":"'), F.sha2("s_name", 256), F.lit('"}'))
    files = table(spark, d, "supplier").select(k.cast("string").alias("package_id"), F.lit("manifest.json").alias("path"), F.encode(body, "UTF-8").alias("content"))
    shown = query.package_info(packages.manifests(files))
    return shown.withColumn("mesh", F.try_element_at("capabilities", F.lit("mesh"))).drop("capabilities")


_OUTCOMES = f"""{_DIAG}, pr AS (SELECT * FROM (VALUES (0, 'pass'), (1, 'waived'), (2, 'requires_review'), (3, 'fail'), (4, 'error')) t(r, s)),
votes AS (SELECT package_id, CASE WHEN severity = 'error' AND affected_count >= 90 THEN 'error' WHEN severity = 'error' AND affected_count >= 70 THEN 'fail' WHEN severity = 'warning' AND affected_count >= 95 THEN 'requires_review' WHEN affected_count = 1 THEN 'waived' ELSE 'pass' END AS s FROM diag),
o AS (SELECT package_id, max(r) AS r FROM votes JOIN pr USING (s) GROUP BY 1), f AS (SELECT u.package_id, coalesce(pr.s, 'pass') AS s FROM (SELECT DISTINCT package_id FROM diag) u LEFT JOIN o USING (package_id) LEFT JOIN pr ON pr.r = o.r),
verdicts AS (SELECT package_id, CASE s WHEN 'waived' THEN 'requires_review' ELSE s END AS outcome, CASE s WHEN 'pass' THEN 0 WHEN 'error' THEN 2 ELSE 1 END AS exit_code FROM f)"""


@register(f"WITH {_OUTCOMES} SELECT * FROM verdicts")
def gate_outcome(spark, d):
    diag = diagnostics(spark, d)
    n = F.col("affected_count")
    status = F.when((F.col("severity") == "error") & (n >= 90), "error").when((F.col("severity") == "error") & (n >= 70), "fail").when((F.col("severity") == "warning") & (n >= 95), "requires_review").when(n == 1, "waived").otherwise("pass")
    votes = diag.select("package_id", status.alias("status"))
    return gate.outcomes(votes.groupBy("package_id").agg(worst(F.col("status")).alias("status")), diag.select("package_id"))


@register(f"WITH {_OUTCOMES} SELECT outcome, exit_code, count(*) AS n FROM verdicts GROUP BY 1, 2")
def status_histogram(spark, d):
    return gate_outcome(spark, d).groupBy("outcome", "exit_code").agg(F.count("*").alias("n"))


_WAIVERS = f"""WITH {_STATE_FINDINGS}, {_DIAG},
fp AS (SELECT package_id, subject_id, disposition, md5(package_id || '|' || subject_id) AS fingerprint FROM sf),
w AS (SELECT d.package_id, d.record_id AS waiver_id, coalesce((SELECT min(fingerprint) FROM fp WHERE fp.package_id = d.package_id), 'none') AS fingerprint, d.ts AS issued_at, d.ts + INTERVAL 7 DAY AS expires_at FROM diag d WHERE d.code = 'signup' OR d.line % 50 = 0),
ws AS (SELECT w.*, CASE WHEN TIMESTAMP '2024-01-15 00:00:00' < issued_at THEN 'not_yet_valid' WHEN TIMESTAMP '2024-01-15 00:00:00' >= expires_at THEN 'expired' WHEN w.fingerprint = 'none' THEN 'mismatch' ELSE 'active' END AS state FROM w)"""


def _waivers(spark, d):
    findings = _state_findings(spark, d).withColumn("fingerprint", F.md5(F.concat_ws("|", F.col("package_id").cast("string"), "subject_id")))
    first = findings.groupBy("package_id").agg(F.min("fingerprint").alias("fingerprint"))
    chosen = diagnostics(spark, d).filter("code = 'signup' or line % 50 = 0").join(first, "package_id", "left")
    waivers = chosen.select("package_id", F.col("record_id").alias("waiver_id"), F.lit("values").alias("check_id"), F.coalesce("fingerprint", F.lit("none")).alias("fingerprint"), F.col("ts").alias("issued_at"), (F.col("ts") + F.expr("interval 7 days")).alias("expires_at"))
    return findings, waivers, F.lit("2024-01-15 00:00:00").cast("timestamp")


@register(f"{_WAIVERS} SELECT package_id, waiver_id, state FROM ws")
def waiver_lifecycle(spark, d):
    findings, waivers, moment = _waivers(spark, d)
    return gate.waiver_states(waivers, findings, moment).select("package_id", "waiver_id", "state")


@register(f"""{_WAIVERS} SELECT fp.package_id, fp.subject_id, CASE WHEN a.fingerprint IS NULL THEN fp.disposition ELSE 'waived' END AS disposition, a.waiver_id FROM fp
LEFT JOIN (SELECT package_id, fingerprint, min(waiver_id) AS waiver_id FROM ws WHERE state IN ('active', 'mismatch') GROUP BY 1, 2) a USING (package_id, fingerprint)""")
def waivers_applied(spark, d):
    findings, waivers, moment = _waivers(spark, d)
    return gate.apply_waivers(findings, waivers, moment).select("package_id", "subject_id", "disposition", "waiver_id")


@register(f"""WITH {_OUTCOMES}, {_STATE_FINDINGS}, checks AS (SELECT package_id, max(CASE disposition WHEN 'fail' THEN 1 ELSE 0 END) AS bad FROM sf GROUP BY 1)
SELECT package_id, 'summary' AS kind, CASE exit_code WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'notice' END AS level, '{{"exit_code":' || exit_code || ',"outcome":"' || outcome || '"}}' AS body FROM verdicts
UNION ALL SELECT package_id, 'check', CASE bad WHEN 1 THEN 'error' ELSE 'warning' END, '{{"check_id":"values","status":"' || CASE bad WHEN 1 THEN 'fail' ELSE 'requires_review' END || '"}}' FROM checks
UNION ALL SELECT package_id, 'finding', CASE disposition WHEN 'fail' THEN 'error' ELSE 'warning' END, '{{"check_id":"values","code":"' || code || '","disposition":"' || disposition || '","observed_state":"' || observed_state || '","subject_id":"' || subject_id || '"}}' FROM sf""")
def ci_annotations(spark, d):
    verdicts, findings = gate_outcome(spark, d), _state_findings(spark, d)
    return gate.annotations(verdicts, gate.check_statuses(findings), findings)


# ---- hashes, references, sets


@register("""SELECT o_custkey AS package_id, sha256(string_agg(line, '' ORDER BY line)) AS logical_digest FROM (SELECT o_custkey, 'orders/' || o_orderkey || chr(0) || sha256(o_orderstatus) || chr(0) || o_orderkey || chr(10) AS line FROM orders) GROUP BY 1""")
def logical_digest(spark, d):
    o = table(spark, d, "orders")
    line = canon.inventory_line(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")), F.sha2("o_orderstatus", 256), F.col("o_orderkey"))
    return canon.ordered_digests(o.withColumnRenamed("o_custkey", "package_id"), "package_id", line, "logical_digest")


@register("SELECT c_custkey, 'entity_' || substr(sha256(c_mktsegment || chr(0) || c_name), 1, 24) AS record_id FROM customer")
def stable_ids(spark, d):
    return table(spark, d, "customer").select("c_custkey", canon.stable_id("entity", F.col("c_mktsegment"), F.col("c_name")).alias("record_id"))


@register("SELECT l_orderkey, string_agg(DISTINCT 'part-' || l_partkey, ',' ORDER BY 'part-' || l_partkey) AS refs FROM lineitem GROUP BY 1")
def evidence_refs(spark, d):
    part = F.concat(F.lit("part-"), F.col("l_partkey").cast("string"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(canon.sorted_distinct(F.collect_list(part)), ",").alias("refs"))


@register("SELECT page_id, replace(replace(url, '~', '~0'), '/', '~1') AS segment, replace(replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), '[', '&#91;'), ']', '&#93;') AS safe FROM pages")
def escapes(spark, d):
    return table(spark, d, "pages").select("page_id", canon.pointer_segment(F.col("url")).alias("segment"), canon.markdown_safe(F.col("html")).alias("safe"))


@register("""WITH c AS (SELECT DISTINCT c_nationkey AS n FROM customer WHERE c_acctbal > 9000), s AS (SELECT DISTINCT s_nationkey AS n FROM supplier WHERE s_acctbal > 5000)
SELECT 'only_customers' AS kind, n FROM (SELECT n FROM c EXCEPT SELECT n FROM s) UNION ALL SELECT 'both', n FROM (SELECT n FROM c INTERSECT SELECT n FROM s) UNION ALL SELECT 'only_suppliers', n FROM (SELECT n FROM s EXCEPT SELECT n FROM c)""")
def set_ops(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("n")).distinct()
    s = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n")).distinct()
    named = lambda kind, rows: rows.select(F.lit(kind).alias("kind"), "n")
    return named("only_customers", c.subtract(s)).union(named("both", c.intersect(s))).union(named("only_suppliers", s.subtract(c)))


# ---- context


@register("""SELECT kind, count(*) AS n, min(r) AS rank FROM (SELECT CASE event_type WHEN 'error' THEN 'diagnostic' WHEN 'view' THEN 'source' WHEN 'click' THEN 'entity' WHEN 'signup' THEN 'unsupported' ELSE 'primitive' END AS kind,
CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 0 WHEN 'click' THEN 4 WHEN 'signup' THEN 9 ELSE 2 END AS r FROM events) GROUP BY 1""")
def context_priority(spark, d):
    kind = F.when(F.col("event_type") == "error", "diagnostic").when(F.col("event_type") == "view", "source").when(F.col("event_type") == "click", "entity").when(F.col("event_type") == "signup", "unsupported").otherwise("primitive")
    rows = table(spark, d, "events").select(kind.alias("kind"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.min(context.priority(F.col("kind"), "audit")).alias("rank"))


@register("SELECT doc_id, ((octet_length(encode(text)) + 3) // 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", canon.token_estimate(F.col("text")).alias("tokens"))


@register("""WITH RECURSIVE s AS (SELECT coalesce(source, '') AS package_id, doc_id, coalesce(octet_length(encode(text)), 0) AS size, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY coalesce(source, '')) AS total FROM documents),
w AS (SELECT package_id, 0::BIGINT AS k, NULL::BIGINT AS doc_id, 0::BIGINT AS admitted, 0::BIGINT AS chunk, 0::BIGINT AS closed, 0::BIGINT AS held, 0::BIGINT AS links, NULL::BIGINT AS put FROM (SELECT DISTINCT package_id FROM s)
UNION ALL SELECT package_id, k, doc_id, CASE WHEN fits THEN admitted + 1 ELSE admitted END, CASE WHEN fits THEN chunk2 ELSE chunk END, CASE WHEN fits THEN closed2 ELSE closed END, CASE WHEN fits THEN held2 ELSE held END, CASE WHEN fits THEN links2 ELSE links END, CASE WHEN fits THEN chunk2 END FROM (
  SELECT *, (size + 3) // 4 <= 4000 AND (400 + links2 + length((admitted + 1)::VARCHAR) + length((total - admitted - 1)::VARCHAR) + 3) // 4 + closed2 + (held2 + 3) // 4 <= 40000 AS fits FROM (
    SELECT *, CASE WHEN opens THEN chunk + 1 ELSE chunk END AS chunk2, CASE WHEN opens THEN closed + (held + 3) // 4 ELSE closed END AS closed2,
      CASE WHEN opens THEN 18 + length((chunk + 1)::VARCHAR) + size ELSE held + size END AS held2, CASE WHEN opens THEN links + 25 + 2 * greatest(3, length((chunk + 1)::VARCHAR)) ELSE links END AS links2 FROM (
      SELECT w.package_id, s.k, s.doc_id, w.admitted, w.chunk, w.closed, w.held, w.links, s.size, s.total, w.chunk = 0 OR (w.held + s.size + 3) // 4 > 4000 AS opens
      FROM w JOIN s ON s.package_id = w.package_id AND s.k = w.k + 1))))
SELECT package_id, doc_id AS place, doc_id AS record_id, coalesce(put, 0) AS chunk FROM w WHERE k > 0""")
def context_pack(spark, d):
    """Each source as a package, its documents as sections. Chunk 0 is for what is left out."""
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("package_id"), F.col("doc_id").alias("place"), F.col("doc_id").alias("record_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    totals = docs.groupBy("package_id").agg(F.count("*").alias("total"))
    return context.pack(docs.join(totals, "package_id")).withColumn("chunk", F.coalesce("chunk", F.lit(0).cast("long")))


# ---- graph


@register("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1")
def endpoint_semi(spark, d):
    ends = table(spark, d, "lineitem").select(F.col("l_partkey").alias("record_id"), "l_returnflag")
    entities = table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("record_id"))
    return graph.entity_endpoints(ends, entities).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@register("SELECT l_orderkey, l_suppkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > -500)")
def dangling_refs(spark, d):
    refs = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    return graph.dangling(refs, table(spark, d, "supplier").filter("s_acctbal > -500").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey").select("l_orderkey", "l_suppkey")


@register("""SELECT 'r' || r_regionkey AS root, depth, count(*) AS n FROM (
SELECT r_regionkey, 0 AS depth, 'x' AS node FROM region UNION ALL SELECT n_regionkey, 1, n_name FROM nation UNION ALL SELECT n_regionkey, 2, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT n_regionkey, 3, o_orderkey::VARCHAR FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey) GROUP BY 1, 2""")
def lineage_closure(spark, d):
    n, c, o = (table(spark, d, t) for t in ("nation", "customer", "orders"))
    node = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    edges = n.select(node("r", "n_regionkey").alias("parent"), node("n", "n_nationkey").alias("child"))
    edges = edges.union(c.select(node("n", "c_nationkey"), node("c", "c_custkey"))).union(o.select(node("c", "o_custkey"), node("o", "o_orderkey")))
    roots = table(spark, d, "region").select(node("r", "r_regionkey").alias("root"))
    return graph.lineage(edges, roots).groupBy("root", "depth").agg(F.count("*").alias("n"))


_BOXES = "boxes AS (SELECT p_partkey AS id, p_brand, (p_partkey % 100)::DOUBLE AS x0, (p_partkey % 37)::DOUBLE AS y0, (p_partkey % 100 + p_size)::DOUBLE AS x1, (p_partkey % 37 + p_size % 7 + 1)::DOUBLE AS y1 FROM part)"


@register(f"WITH {_BOXES} SELECT o.p_brand, o.id AS outer_id, i.id AS inner_id FROM boxes o JOIN boxes i ON o.p_brand = i.p_brand AND o.id <> i.id AND o.x0 <= i.x0 AND o.y0 <= i.y0 AND i.x1 <= o.x1 AND i.y1 <= o.y1")
def bbox_containment(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    boxes = table(spark, d, "part").select(k.alias("id"), "p_brand", (k % 100).cast("double").alias("x0"), (k % 37).cast("double").alias("y0"), (k % 100 + s).cast("double").alias("x1"), (k % 37 + s % 7 + 1).cast("double").alias("y1"))
    return graph.contained_boxes(boxes, 16.0, ("p_brand",)).select("p_brand", F.col("outer").alias("outer_id"), F.col("inner").alias("inner_id"))


# ---- geometry


def _points(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", "label", *[e[k].cast("double").alias(c) for k, c in enumerate(("x", "y", "z"))])


@register("SELECT label, min(embedding[1]::DOUBLE) AS min_x, max(embedding[1]::DOUBLE) AS max_x, min(embedding[2]::DOUBLE) AS min_y, max(embedding[2]::DOUBLE) AS max_y, min(embedding[3]::DOUBLE) AS min_z, max(embedding[3]::DOUBLE) AS max_z FROM embeddings GROUP BY 1")
def bounds(spark, d):
    return geometry.bounds(_points(spark, d), ["label"])


@register("SELECT vec_id, round(2 * (0.8 * embedding[1]::DOUBLE - 0.6 * embedding[2]::DOUBLE) + 10, 6) AS x, round(2 * (0.6 * embedding[1]::DOUBLE + 0.8 * embedding[2]::DOUBLE) + 20, 6) AS y, round(2 * embedding[3]::DOUBLE + 5, 6) AS z FROM embeddings")
def affine_points(spark, d):
    m = values.map_conversion(F.lit(2.0), F.lit(10.0), F.lit(20.0), F.lit(5.0), F.lit(0.8), F.lit(0.6))
    p = values.affine(m, F.col("x"), F.col("y"), F.col("z"))
    return _points(spark, d).select("vec_id", *[F.round(p[k], 6).alias(c) for k, c in enumerate(("x", "y", "z"))])


@register("""WITH r AS (SELECT label, (embedding[1]::DOUBLE - embedding[4]::DOUBLE) ** 2 + (embedding[2]::DOUBLE - embedding[5]::DOUBLE) ** 2 + (embedding[3]::DOUBLE - embedding[6]::DOUBLE) ** 2 AS d2 FROM embeddings)
SELECT label, round(sqrt(max(d2)), 6) AS max_residual, round(sqrt(avg(d2)), 6) AS rms_residual FROM r GROUP BY 1""")
def residuals(spark, d):
    e = F.col("embedding")
    pairs = table(spark, d, "embeddings").select("label", *[e[k].cast("double").alias(c) for k, c in enumerate(("x", "y", "z", "tx", "ty", "tz"))])
    return geometry.residuals(pairs, ["label"]).select("label", F.round("max_residual", 6).alias("max_residual"), F.round("rms_residual", 6).alias("rms_residual"))


@register("""WITH n AS (SELECT label, count(*) FILTER (embedding[1] IS NOT NULL AND embedding[2] IS NOT NULL AND embedding[3] IS NOT NULL) AS n FROM embeddings GROUP BY 1)
SELECT label, CASE WHEN n < 3 THEN 'insufficient' ELSE 'known' END AS status, CASE WHEN n >= 3 THEN 2.0::DOUBLE END AS scale, CASE WHEN n >= 3 THEN '1.2,-1.6,0.0,500000.0,1.6,1.2,0.0,5000000.0,0.0,0.0,2.0,5.0' END AS matrix FROM n WHERE n > 0""")
def similarity_solution(spark, d):
    """Points moved to map coordinates."""
    m = values.map_conversion(F.lit(2.0), F.lit(500000.0), F.lit(5000000.0), F.lit(5.0), F.lit(0.6), F.lit(0.8))
    p = values.affine(m, F.col("x"), F.col("y"), F.col("z"))
    points = _points(spark, d).withColumns({f"t{c}": p[k] for k, c in enumerate(("x", "y", "z"))})
    solved = geometry.similarity(points, "label", 1e-5)
    cells = F.transform(F.slice("matrix", 1, 12), lambda x: (F.round(x, 4) + F.lit(0.0)).cast("string"))
    return solved.select("label", "status", F.round("scale", 6).alias("scale"), F.array_join(cells, ",").alias("matrix"))


@register("""SELECT label, sum(CASE WHEN abs(r - 1) <= 1e-6 THEN 1 ELSE 0 END)::BIGINT AS matching, count(*) AS n FROM (SELECT label, CASE WHEN vec_id % 3 = 0 THEN 2.0 ELSE 1.0 END AS r FROM embeddings) GROUP BY 1""")
def inverse_check(spark, d):
    k = F.col("x") + 3.0
    zero, one = F.lit(0.0), F.lit(1.0)
    diagonal = lambda v: F.array(v, zero, zero, zero, zero, v, zero, zero, zero, zero, v, zero, zero, zero, zero, one)
    wrong = F.when(F.col("vec_id") % 3 == 0, 2.0).otherwise(1.0)
    rows = _points(spark, d).select("label", values.inverse_matches(diagonal(k), diagonal(wrong / k)).alias("ok"))
    return rows.groupBy("label").agg(F.count_if("ok").alias("matching"), F.count("*").alias("n"))


# ---- inference


@register("""WITH l AS (SELECT l_orderkey AS page_id, l_suppkey % 3 AS line, l_partkey % 500 AS le, l_suppkey % 40 AS t, l_linenumber * 3 AS w, l_quantity AS c FROM lineitem)
SELECT page_id, line, min(le) AS "left", min(t) AS top, max(le + w) - min(le) AS width, max(t + 10) - min(t) AS height, count(*) AS n_words, round(avg(c), 6) AS confidence FROM l GROUP BY 1, 2""")
def hierarchy_rollup(spark, d):
    words = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), (F.col("l_suppkey") % 3).alias("line"), (F.col("l_partkey") % 500).alias("left"), (F.col("l_suppkey") % 40).alias("top"), (F.col("l_linenumber") * 3).cast("long").alias("width"), F.lit(10).cast("long").alias("height"), F.col("l_quantity").alias("confidence"))
    return inference.union_boxes(words, ["page_id", "line"]).withColumn("confidence", F.round("confidence", 6))


@register("""WITH e AS (SELECT user_id AS page_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS reading_order, event_id, event_type FROM events WHERE value >= 20)
SELECT page_id, count(*) AS n, max(reading_order) AS last_place, min(event_id) AS first_id, string_agg(event_type, ' ' ORDER BY reading_order) AS text FROM e GROUP BY 1""")
def reading_order(spark, d):
    """Events as the recogniser's lines of the page of their user: the place in ``left``, the value as confidence."""
    line = F.concat_ws("\t", F.lit("5\t1\t1\t1\t1"), F.lit("1"), F.col("event_id").cast("string"), F.lit("0\t4\t9"), F.col("value").cast("string"), F.col("event_type"))
    pages = table(spark, d, "events").groupBy(F.col("user_id").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("tsv"))
    words = inference.words_from_tsv(pages, 20.0)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "text"))), lambda x: x["text"]), " ")
    return words.groupBy("page_id").agg(F.count("*").alias("n"), F.max("reading_order").cast("long").alias("last_place"), F.min("left").cast("long").alias("first_id"), text.alias("text"))


@register("""WITH n AS (SELECT item_id AS k, text FROM benchmark), r AS (SELECT doc_id AS k, CASE WHEN lang = 'en' THEN text END AS text FROM documents)
SELECT CASE WHEN n.text IS NOT NULL AND r.text IS NOT NULL AND lower(trim(n.text)) <> lower(trim(r.text)) THEN 'conflicted' ELSE 'known' END AS state, count(*) AS n FROM n FULL JOIN r ON n.k = r.k GROUP BY 1""")
def native_conflict(spark, d):
    native = table(spark, d, "benchmark").select(F.col("item_id").alias("k"), "text")
    seen = table(spark, d, "documents").select(F.col("doc_id").alias("k"), F.when(F.col("lang") == "en", F.col("text")).alias("text"))
    return inference.text_conflicts(native, seen, "k", lambda c: F.lower(F.trim(c))).groupBy("state").agg(F.count("*").alias("n"))


@register("SELECT user_id, 'check-' || printf('%04d', row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS finding_id, event_id FROM events WHERE event_type = 'error'")
def finding_index(spark, d):
    return gate.finding_ids(table(spark, d, "events").filter("event_type = 'error'"), ["user_id"], ["event_id"]).select("user_id", "finding_id", "event_id")


# ---- trust


_KEYS = """keys AS (SELECT c_custkey, 'kid-' || c_custkey AS kid, c_mktsegment AS subject, DATE '2024-01-01' + (c_custkey % 60)::INTEGER AS vf, DATE '2024-03-01' + (c_custkey % 45)::INTEGER AS vu,
CASE c_custkey % 10 WHEN 0 THEN 'revoked' WHEN 1 THEN 'unknown' ELSE 'good' END AS rs, DATE '2024-02-01' + (c_custkey % 70)::INTEGER AS ra, CASE WHEN c_custkey % 3 = 0 THEN 'read' ELSE 'read,sign' END AS scopes FROM customer),
k1 AS (SELECT *, CASE WHEN DATE '2024-03-10' < vf THEN 'not_yet_valid' WHEN DATE '2024-03-10' >= vu THEN 'expired' WHEN rs = 'revoked' AND DATE '2024-03-10' >= ra THEN 'revoked' WHEN rs = 'unknown' THEN 'unknown_status' ELSE 'valid' END AS key_status FROM keys),
k2 AS (SELECT *, CASE WHEN key_status = 'valid' AND (subject = 'BUILDING' OR kid = 'kid-7') THEN 'trusted' ELSE 'untrusted' END AS trust_status FROM k1),
k3 AS (SELECT *, CASE WHEN trust_status = 'trusted' AND scopes = 'read,sign' THEN 'authorized' ELSE 'unauthorized' END AS authorization_status FROM k2)"""


def _evaluated(spark, d):
    k = F.col("c_custkey")
    day = lambda start, n: F.date_add(F.lit(start).cast("date"), (k % n).cast("int")).cast("timestamp")
    status = F.when(k % 10 == 0, "revoked").when(k % 10 == 1, "unknown").otherwise("good")
    scopes = F.when(k % 3 == 0, F.array(F.lit("read"))).otherwise(F.array(F.lit("read"), F.lit("sign")))
    keys = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("kid-"), k.cast("string")).alias("kid"), F.col("c_mktsegment").alias("subject"), day("2024-01-01", 60).alias("valid_from"), day("2024-03-01", 45).alias("valid_until"), status.alias("revocation_status"), day("2024-02-01", 70).alias("revoked_at"), scopes.alias("scopes"))
    return trust.evaluate_keys(keys, F.lit("2024-03-10").cast("timestamp"), ["kid-7"], ["BUILDING"], ["sign"])


@register(f"WITH {_KEYS} SELECT kid, key_status, trust_status, authorization_status FROM k3")
def key_ladder(spark, d):
    return _evaluated(spark, d).select("kid", "key_status", "trust_status", "authorization_status")


@register(f"""WITH {_KEYS}, s AS (SELECT o_orderkey // 10 AS package_id, o_custkey, o_orderstatus <> 'P' OR o_orderkey % 4 <> 0 AS ok FROM orders),
j AS (SELECT s.package_id, s.ok, k3.kid, k3.authorization_status FROM s LEFT JOIN k3 ON k3.c_custkey = s.o_custkey),
g AS (SELECT package_id, count(*) FILTER (ok) AS n_valid, count(DISTINCT kid) FILTER (ok AND authorization_status = 'authorized') AS n_authorized, bool_and(ok) AS all_valid FROM j GROUP BY 1)
SELECT package_id, n_valid, n_authorized, CASE WHEN NOT all_valid THEN 'invalid' WHEN n_authorized >= 1 THEN 'verified' ELSE 'unauthorized' END AS verdict FROM g""")
def signer_threshold(spark, d):
    o = table(spark, d, "orders")
    signatures = o.select(F.floor(F.col("o_orderkey") / 10).alias("package_id"), F.concat(F.lit("kid-"), F.col("o_custkey").cast("string")).alias("kid"), ((F.col("o_orderstatus") != "P") | (F.col("o_orderkey") % 4 != 0)).alias("is_valid"))
    return trust.verify_bundles(signatures, _evaluated(spark, d), 1)


@register("""WITH lists AS (SELECT event_id AS list_id, user_id AS issuer, ts AS lu, ts + INTERVAL 3 DAY AS nu FROM events WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-20'),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY lu DESC, list_id DESC) AS n FROM lists) WHERE n = 1)
SELECT c.c_custkey AS serial, c.c_custkey % 200 AS issuer, CASE WHEN l.list_id IS NULL THEN 'unknown' WHEN TIMESTAMP '2024-01-20' >= l.nu THEN 'stale' WHEN c.c_custkey % 5 = l.list_id % 5 THEN 'revoked' ELSE 'good' END AS status
FROM customer c LEFT JOIN newest l ON l.issuer = c.c_custkey % 200""")
def revocation(spark, d):
    moment = F.lit("2024-01-20").cast("timestamp")
    e = table(spark, d, "events").filter((F.col("event_type") == "view") & (F.col("ts") < moment))
    lists = e.select(F.col("user_id").alias("issuer"), F.col("event_id").alias("list_id"), F.col("ts").alias("last_update"), (F.col("ts") + F.expr("interval 3 days")).alias("next_update"))
    certs = table(spark, d, "customer").select((F.col("c_custkey") % 200).alias("issuer"), F.col("c_custkey").alias("serial"))
    newest = lists.groupBy("issuer").agg(F.max_by("list_id", F.struct("last_update", "list_id")).alias("list_id"))
    revoked = certs.join(newest, "issuer").filter("serial % 5 = list_id % 5").select("list_id", "serial", F.lit("2024-01-02").cast("timestamp").alias("revoked_at"))
    return trust.revocation_status(certs, lists, revoked, moment).select("serial", "issuer", "status")


@register("""WITH s AS (SELECT o_custkey AS package_id, o_orderstatus <> 'P' AND o_orderkey % 3 <> 0 AS auth, o_orderkey % 2 = 0 AS arch FROM orders)
SELECT package_id, count(*) FILTER (auth) AS n_authorized, count(*) FILTER (auth AND arch) AS n_archived, count(*) FILTER (auth) >= 2 AND count(*) FILTER (auth AND arch) > 0 AS policy_satisfied FROM s GROUP BY 1""")
def advanced_verdict(spark, d):
    key = F.col("o_orderkey")
    signatures = table(spark, d, "orders").select(
        F.col("o_custkey").alias("package_id"),
        F.concat(F.lit("kid-"), key.cast("string")).alias("kid"),
        F.when(F.col("o_orderstatus") == "P", "invalid").otherwise("valid").alias("cryptographic_status"),
        F.lit("valid").alias("lifecycle_status"),
        F.lit("trusted").alias("trust_status"),
        F.lit(True).alias("subject_allowed"),
        F.when(key % 3 != 0, True).alias("scopes_allowed"),
        F.when(key % 2 == 0, "valid").otherwise("absent").alias("archival_time_status"),
    )
    return trust.advanced_verdicts(signatures, 2, True)


# ---- sources


_KINDS = [("'%PDF-1.7'", "pdf"), ("'glTF'", "geometry"), ("'AC1032'", "dwg"), ("'iso-10303-21; file_schema((''ifc4''));'", "ifc"), ("'ISO-10303-21; FILE_SCHEMA((''AP214''));'", "step-iges"), ("'P5 2 2 255'", "image"), ("'solid x facet normal'", "geometry"), ("''", "opaque")]


@register(f"SELECT page_id, CASE page_id % 8 {' '.join(f"WHEN {k} THEN '{kind}'" for k, (_, kind) in enumerate(_KINDS))} END AS kind, octet_length(encode(CASE page_id % 8 {' '.join(f'WHEN {k} THEN {mark}' for k, (mark, _) in enumerate(_KINDS))} END || html)) AS bytes FROM pages")
def probe_kind(spark, d):
    """Pages behind the marks of file formats; by themselves they are opaque."""
    mark = F.element_at(F.array(*[F.lit(m[1:-1].replace("''", "'")) for m, _ in _KINDS]), (F.col("page_id") % 8 + 1).cast("int"))
    files = table(spark, d, "pages").select(F.lit("p").alias("package_id"), "page_id", F.col("url").alias("path"), F.concat(mark, "html").cast("binary").alias("content"))
    return files.select("page_id", scanners.detect(F.col("content")).alias("kind"), F.octet_length("content").cast("long").alias("bytes"))


@register("""SELECT CASE level WHEN 'full' THEN 3 WHEN 'partial' THEN 2 WHEN 'opaque' THEN 1 ELSE 0 END AS ordinal, level, count(*) AS n FROM (SELECT CASE WHEN p_size >= 40 THEN 'full' WHEN p_size >= 25 THEN 'partial' WHEN p_size >= 10 THEN 'opaque' ELSE 'unsupported' END AS level FROM part) GROUP BY 1, 2""")
def support_ordinals(spark, d):
    level = F.when(F.col("p_size") >= 40, "full").when(F.col("p_size") >= 25, "partial").when(F.col("p_size") >= 10, "opaque").otherwise("unsupported")
    return table(spark, d, "part").select(level.alias("level")).groupBy(rank(F.col("level"), SUPPORT_LEVELS).alias("ordinal"), "level").agg(F.count("*").alias("n"))


# ---- drawings and providers


@register("""WITH e AS (SELECT user_id, event_id, event_type, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS t FROM events)
SELECT user_id, CASE WHEN p < t THEN p ELSE -1 END AS path, count(*) AS n, min(event_id) AS first_id FROM e GROUP BY 1, 2""")
def path_grouping(spark, d):
    ops = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("op"))
    return drawings.group_paths(ops, ["user_id"], ("purchase",)).groupBy("user_id", F.coalesce("path", F.lit(-1)).alias("path")).agg(F.count("*").alias("n"), F.min("seq").alias("first_id"))


@register("""WITH RECURSIVE e AS (SELECT p_partkey AS parent, (p_partkey * 7 + 3) % (SELECT max(p_partkey) + 1 FROM part) AS child, p_size::DOUBLE AS dx FROM part WHERE p_size > 20),
w AS (SELECT p_partkey AS root, p_partkey AS node, 0 AS depth, [p_partkey] AS way, 'ok' AS status, 0.0::DOUBLE AS x FROM part
UNION ALL SELECT w.root, e.child, w.depth + 1, list_append(w.way, e.child), CASE WHEN list_contains(w.way, e.child) THEN 'cycle' WHEN w.depth + 1 > 8 THEN 'too_deep' ELSE 'ok' END, w.x + e.dx FROM w JOIN e ON e.parent = w.node WHERE w.status = 'ok')
SELECT root, node, depth, status, x FROM w""")
def reference_walk(spark, d):
    """Every part as a root; a step moves by the part's size along x."""
    p = table(spark, d, "part")
    size = p.agg(F.max("p_partkey") + 1).first()[0] or 1
    zero = F.lit(0.0)
    matrix = drawings.insert_matrix(F.col("p_size").cast("double"), zero, zero, F.lit(1.0), zero)
    edges = p.filter("p_size > 20").select(F.col("p_partkey").alias("parent"), ((F.col("p_partkey") * 7 + 3) % size).alias("child"), matrix.alias("matrix"))
    walked = drawings.walk(edges, p.select(F.col("p_partkey").alias("root")), 8)
    return walked.select("root", "node", "depth", "status", F.col("matrix")[3].alias("x"))


@register("SELECT p_partkey, round(p_size + p_size * cos(pi() * k / 4), 6) AS x, round(p_size * sin(pi() * k / 4), 6) AS y FROM part, generate_series(0, 4) g(k)")
def arc_sampling(spark, d):
    r = F.col("p_size").cast("double")
    points = drawings.arc_points(r, F.lit(0.0), r, F.lit(0.0), F.acos(F.lit(-1.0)), 4)
    rows = table(spark, d, "part").select("p_partkey", F.explode(points).alias("p"))
    return rows.select("p_partkey", F.round(F.col("p")[0], 6).alias("x"), F.round(F.col("p")[1], 6).alias("y"))


@register("""SELECT CASE c_custkey % 6 WHEN 0 THEN 'explicit_null' WHEN 1 THEN 'not_applicable' WHEN 2 THEN 'known' WHEN 3 THEN 'unknown' WHEN 4 THEN 'known' ELSE 'unsupported' END AS state, CASE c_custkey % 6 WHEN 2 THEN c_name WHEN 4 THEN c_mktsegment END AS value, c_custkey FROM customer""")
def attribute_states(spark, d):
    k = F.col("c_custkey") % 6
    quoted = lambda c: F.concat(F.lit("'"), F.col(c), F.lit("'"))
    text = F.when(k == 0, "$").when(k == 1, "*").when(k == 2, quoted("c_name")).when(k == 3, ".U.").when(k == 4, F.concat(F.lit("IFCLABEL("), quoted("c_mktsegment"), F.lit(")"))).otherwise("(1,2)")
    state = drawings.attribute_state(text)
    return table(spark, d, "customer").select(state["state"].alias("state"), state["value"].alias("value"), "c_custkey")


@register("""WITH c AS (SELECT s_nationkey AS package_id, count(*) FILTER (s_acctbal > 3000) AS supported, count(*) AS total FROM supplier GROUP BY 1)
SELECT package_id, 'geometry' AS capability, CASE WHEN supported = total THEN 'full' WHEN supported > 0 THEN 'partial' ELSE 'opaque' END AS level, CASE WHEN supported = total THEN NULL WHEN supported > 0 THEN 'GEOMETRY_PARTIAL' ELSE 'GEOMETRY_OPAQUE' END AS reason, total - supported AS affected FROM c""")
def capability_derivation(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("package_id"), F.lit("geometry").alias("capability"), (F.col("s_acctbal") > 3000).cast("long").alias("supported"), F.lit(1).cast("long").alias("total"))
    return drawings.derive_capabilities(s)


@register("""WITH n AS (SELECT c_nationkey AS k, count(*) FILTER (c_custkey % 40 = 0) AS conv, count(*) FILTER (c_custkey % 50 = 0) AS sys FROM customer GROUP BY 1)
SELECT k, CASE WHEN conv = 0 AND sys = 0 THEN 'none' WHEN conv > 1 OR sys > 1 THEN 'conflicted' WHEN conv = 0 OR sys = 0 THEN 'incomplete' WHEN k % 2 = 0 THEN 'unit_conflict' ELSE 'known' END AS state FROM n""")
def georeference(spark, d):
    n = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count_if(F.col("c_custkey") % 40 == 0).alias("conv"), F.count_if(F.col("c_custkey") % 50 == 0).alias("sys"))
    odd = F.col("k") % 2 == 1
    return n.select("k", drawings.georeference_state(F.col("conv"), F.col("sys"), F.when(odd, 1.0), F.lit("m"), F.lit("mm")).alias("state"))


@register("""SELECT o_custkey AS package_id, 'has F' AS requirement, o_orderkey AS id, 'REQUIREMENT_UNMET' AS code FROM orders o WHERE o_orderpriority = '1-URGENT' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')
UNION ALL SELECT o_custkey, 'no R', o_orderkey, 'REQUIREMENT_PROHIBITED' FROM orders o WHERE o_orderpriority = '2-HIGH' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag IN ('R', 'N'))""")
def requirement_findings(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    instances = o.select(F.col("o_custkey").alias("package_id"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("original_class"))
    held = li.select(F.col("l_orderkey").alias("id"), F.expr("stack(2, 'status', l_linestatus, 'flag', l_returnflag) as (name, value)"))
    properties = held.join(instances.select("package_id", "id"), "id")
    wanted = [{"name": "has F", "entity": "1-URGENT", "property": "status", "value": "F"}, {"name": "no R", "entity": "2-HIGH", "property": "flag", "pattern": "R|N", "cardinality": "prohibited"}]
    return drawings.requirement_findings(instances, properties, wanted)


@register("""WITH o AS (SELECT l_orderkey AS package_id, l_suppkey AS handle, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey) - 1 AS occurrence, count(*) OVER (PARTITION BY l_orderkey, l_suppkey) AS times FROM lineitem)
SELECT package_id, handle, occurrence, CASE WHEN times > 1 THEN 'conflicted' WHEN handle % 3 = 0 THEN 'unmatched' ELSE 'matched' END AS state FROM o""")
def handle_match(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("package_id"), F.col("l_suppkey").alias("handle"), F.struct("l_linenumber", "l_partkey").alias("place"))
    out = providers.match_handles(li, li.filter("handle % 3 <> 0"))
    return out.withColumn("occurrence", F.col("occurrence").cast("long"))


@register("""WITH r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 9 = 0 THEN 'b' ELSE 'a' END AS p, CASE WHEN o_orderkey % 8 = 0 THEN 'x' ELSE 'a' END AS att, o_orderstatus AS payload, sha256(CASE WHEN o_orderkey % 10 = 0 THEN 'x' ELSE o_orderstatus END) AS sha FROM orders)
SELECT o_orderkey AS response_id, 'RESPONSE_REQUEST_UNKNOWN' AS code FROM r WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT o_orderkey, 'RESPONSE_PROVIDER_MISMATCH' FROM r WHERE p <> 'a' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT o_orderkey, 'RESPONSE_ATTESTATION_MISMATCH' FROM r WHERE att <> p UNION ALL SELECT o_orderkey, 'RESPONSE_PAYLOAD_MISMATCH' FROM r WHERE sha <> sha256(payload)""")
def response_validation(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    requests = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("request_id"), F.lit("a").alias("provider_id"))
    said = F.sha2(F.when(key % 10 == 0, "x").otherwise(F.col("o_orderstatus")), 256)
    responses = o.select(key.alias("response_id"), F.col("o_custkey").alias("request_id"), F.when(key % 9 == 0, "b").otherwise("a").alias("provider_id"), F.col("o_orderstatus").alias("payload"), said.alias("payload_sha256"), F.when(key % 8 == 0, "x").otherwise("a").alias("attested_provider"))
    none = responses.select("response_id", F.col("payload").alias("content"), F.sha2("payload", 256).alias("sha256"))
    return providers.check_responses(requests, responses, none)


@register("""SELECT c_custkey, 'request_' || substr(sha256('{"a":"' || c_mktsegment || '","b":' || c_nationkey || '}' || chr(0) || sha256(c_name)), 1, 24) AS request_id FROM customer""")
def request_ids(spark, d):
    text = F.format_string('{"b": %d, "a": "%s"}', "c_nationkey", "c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", providers.request_id(text, F.sha2("c_name", 256)).alias("request_id"))


# ---- scans of files made of rows


def _file(rows, key, content):
    """Texts as files of packages named by a key, dealt out before they are written: a few megabytes of rows are many more of text and work."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, key).select(F.col(key).cast("string").alias("package_id"), F.lit("file").alias("path"), F.encode(content, "UTF-8").alias("content"))


def _number(column):
    return F.col(column).cast("long").cast("string")


@register("""SELECT l_orderkey AS package_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY printf('entity-%010d', l_suppkey)) AS line, printf('entity-%010d', l_suppkey) AS record_id, 'entity' AS record_type FROM lineitem""")
def record_scan(spark, d):
    """Record lines written as sorted files and read again."""
    name = F.format_string("entity-%010d", F.col("l_suppkey").cast("long"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("package_id"), F.lit("model/entities.jsonl").alias("path"), name.alias("record_id"))
    lines = lines.withColumn("json", F.format_string('{"record_id":"%s","record_type":"entity"}', "record_id"))
    return packages.records(packages.jsonl_files(lines)).select("package_id", F.col("line").cast("long").alias("line"), "record_id", "record_type")


_STORE_TYPES = {"model/entities.jsonl": ("entity", "part"), "model/relations.jsonl": ("relation", "line")}


@register("""SELECT l_suppkey::VARCHAR AS package_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY printf('part-%010d', l_partkey)) AS line, printf('part-%010d', l_partkey) AS record_id, 'entity' AS record_type FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)""")
def package_store_records(spark, d):
    """Suppliers as archives in a folder: their parts and order lines as records, written in two phases; entities are read back without opening the relations."""
    li = table(spark, d, "lineitem").withColumn("package_id", F.col("l_suppkey").cast("string"))
    keys = {"part": F.col("l_partkey"), "line": F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber")}
    lines = None
    for path, (kind, name) in _STORE_TYPES.items():
        rows = li.select("package_id", F.lit(path).alias("path"), F.format_string(f"{name}-%010d", keys[name].cast("long")).alias("record_id")).distinct()
        rows = rows.withColumn("json", F.format_string(f'{{"record_id":"%s","record_type":"{kind}"}}', "record_id"))
        lines = rows if lines is None else lines.union(rows)
    folder = f"{shared_dir(spark)}/packages-{uuid.uuid4().hex}"
    package_store.write_packages(packages.jsonl_files(lines), folder)
    return package_store.scan(spark, folder, "record_type = 'entity'").select("package_id", "line", "record_id", "record_type")


@register("""SELECT c_custkey AS package_id, 'SCHEMA_INVALID' AS code, 'model/entities.jsonl:1' || pointer AS path FROM customer, (VALUES (7, ''), (5, '#/record_version'), (3, '#/source_refs/0/locator'), (4, '#/provenance/recorded_at'), (6, '#/provenance')) v(k, pointer)
WHERE c_custkey % k = 0 AND NOT (pointer LIKE '#/prov%' AND c_custkey % 7 = 0)""")
def record_schemas(spark, d):
    k = F.col("c_custkey")
    version = F.when(k % 5 == 0, "3").otherwise("0.2")
    locator = F.when(k % 3 == 0, "").otherwise("row")
    moment = F.when(k % 4 == 0, "soon").otherwise("2024-01-01T00:00:00Z")
    method = F.when(k % 6 == 0, "").otherwise('"method":"m",')
    origin = F.concat(F.lit(',"provenance":{"producer_id":"p","producer_version":"1",'), method, F.lit('"recorded_at":"'), moment, F.lit('","parent_record_ids":["a"]}'))
    body = F.concat(F.lit('{"record_version":"'), version, F.lit('","source_refs":[{"source_id":"s","locator":"'), locator, F.lit('"}]'), F.when(k % 7 == 0, "").otherwise(origin), F.lit("}"))
    return validate.check_schemas(table(spark, d, "customer").select(k.alias("package_id"), F.lit("model/entities.jsonl").alias("path"), F.lit(1).alias("line"), body.alias("json")))


_CHANGES = """changes AS (SELECT s_suppkey AS package_id, category, field AS subject_id FROM supplier, (VALUES (2, 'loss_changes', 'manifest.loss_summary'), (3, 'identity_changes', 'manifest.source_ids'), (5, 'identity_changes', 'manifest.source_embedding_policy'),
(7, 'identity_changes', 'manifest.named'), (4, 'producer_changes', 'manifest.producer'), (11, 'version_changes', 'manifest.format_version')) v(k, category, field) WHERE s_suppkey % k = 0)"""


def _manifest_changes(spark, d):
    k = F.col("s_suppkey")
    name = F.col("s_name")
    keys = lambda *parts: F.create_map(*[x for p in parts for x in p])
    producer = ((F.lit("name"), name), (F.lit("version"), F.lit("1")))
    s = table(spark, d, "supplier").withColumn("package_id", k)
    fixed = {"loss_summary": F.array(name, F.lit("x")), "source_ids": F.array(name), "source_embedding_policy": F.lit("external"), "named": name, "producer": keys(*producer), "format_version": F.lit("0.1.0")}
    other = {"loss_summary": (2, F.array(F.lit("x"), name)), "source_ids": (3, F.array(name, name)), "source_embedding_policy": (5, F.lit("redacted")), "named": (7, F.lit(None).cast("string")), "producer": (4, keys(producer[0], (F.lit("version"), F.lit("2")))), "format_version": (11, F.lit("0.2.0"))}
    after = {c: F.when(k % n == 0, value).otherwise(fixed[c]) for c, (n, value) in other.items()}
    after["producer"] = F.when(k % 4 == 0, other["producer"][1]).otherwise(keys(*producer[::-1]))
    return policy.manifest_changes(s.select("package_id", *[v.alias(c) for c, v in fixed.items()]), s.select("package_id", *[v.alias(c) for c, v in after.items()]))


@register(f"WITH {_CHANGES} SELECT *, 'changed' AS observed_state FROM changes")
def manifest_changes(spark, d):
    return _manifest_changes(spark, d)


@register(f"""WITH {_CHANGES} SELECT package_id, 'regression' AS check_id, 'DIFF_' || upper(category) AS code, subject_id, 'changed' AS observed_state, CASE category WHEN 'loss_changes' THEN 'fail' WHEN 'identity_changes' THEN 'requires_review' ELSE 'error' END AS disposition FROM changes WHERE category <> 'version_changes'""")
def diff_regression(spark, d):
    """Version changes are allowed, and changes of the producer have no action."""
    return gate.diff_regression(_manifest_changes(spark, d), {"loss_changes": "fail", "identity_changes": "requires_review", "version_changes": "allow"})


@register("""WITH p AS (SELECT p_partkey AS part, p_size::DOUBLE AS s FROM part)
SELECT part, 'CIRCLE' AS type, s AS x, 2.0::DOUBLE AS y, 0.0::DOUBLE AS z, 'linear-element' AS kind, 'a' AS layer FROM p UNION ALL SELECT part, 'ARC', -s, 2.0, -3.0, 'linear-element', 'b' FROM p UNION ALL SELECT part, 'CIRCLE', 3.0, s, 2.0, 'linear-element', 'c' FROM p""")
def drawing_planes(spark, d):
    """Parts as drawings: two circles and an arc, their centres in world coordinates."""
    size = _number("p_size")
    marks = ["0 SECTION 2 ENTITIES 0 CIRCLE 8 a 10 ", size, " 20 2 0 ARC 8 b 10 ", size, " 20 2 30 3 210 0 220 0 230 -1 0 CIRCLE 8 c 10 ", size, " 20 2 30 3 210 1 220 0 230 0 0 ENDSEC 0 EOF"]
    text = F.replace(F.concat(*[F.lit(m) if isinstance(m, str) else m for m in marks]), F.lit(" "), F.lit("\n"))
    rows = dxf_geometry.plane_entities(scanners.drawing_entities(_file(table(spark, d, "part"), "p_partkey", text)))
    return rows.select(F.col("package_id").cast("long").alias("part"), "type", *[F.round(F.col("center_world")[k], 9).alias(c) for k, c in enumerate("xyz")], "kind", "layer")


@register("""WITH p AS (SELECT p_partkey AS part, p_size::DOUBLE AS s, greatest(8, ceil(2 * pi() / (2 * acos(1 - least(0.001 / p_size, 1)))))::BIGINT AS n FROM part)
SELECT part, k, round(s + s * cos(2 * pi() * k / n), 6) + 0.0 AS x, round(s / 2 * sin(2 * pi() * k / n), 6) + 0.0 AS y FROM p, range(0, 1000) r(k) WHERE k <= n""")
def drawing_ellipses(spark, d):
    """Parts as whole ellipses; all points of their samples."""
    size = _number("p_size")
    text = F.replace(F.concat(F.lit("0 SECTION 2 ENTITIES 0 ELLIPSE 10 "), size, F.lit(" 20 0 11 "), size, F.lit(" 21 0 40 0.5 0 ENDSEC 0 EOF")), F.lit(" "), F.lit("\n"))
    found = curve_samples.sampled_curves(dxf_geometry.curves(scanners.drawing_entities(_file(table(spark, d, "part"), "p_partkey", text))))
    points = found.select(F.col("package_id").cast("long").alias("part"), F.posexplode("points").alias("k", "p"))
    return points.select("part", F.col("k").cast("long").alias("k"), (F.round(F.col("p")[0], 6) + 0.0).alias("x"), (F.round(F.col("p")[1], 6) + 0.0).alias("y"))


@register("""WITH RECURSIVE p AS (SELECT DISTINCT p_size::DOUBLE AS s FROM part),
spots AS (SELECT s, j, 6 * s * t * t * (1 - t) + s * t * t * t AS x, 6 * t * (1 - t) * (1 - t) + 2 * s * t * t * t AS y FROM p, (SELECT j::INT AS j, j / 1024.0::DOUBLE AS t FROM range(0, 1025) r(j))),
cut AS (SELECT s, (k * 128)::INT AS a, ((k + 1) * 128)::INT AS b FROM p, range(0, 8) r(k)
 UNION ALL SELECT s, unnest([a, (a + b) // 2])::INT, unnest([(a + b) // 2, b])::INT FROM (
  SELECT c.s, c.a, c.b, max(abs((v.y - u.y) * (q.x - u.x) - (v.x - u.x) * (q.y - u.y)) / sqrt((v.x - u.x) ** 2 + (v.y - u.y) ** 2)) AS off
  FROM cut c JOIN spots u ON u.s = c.s AND u.j = c.a JOIN spots v ON v.s = c.s AND v.j = c.b, range(1, 4) r(m) JOIN spots q ON q.s = c.s AND q.j = c.a + m * (c.b - c.a) // 4 GROUP BY ALL) WHERE off > 0.001),
ends AS (SELECT s, a AS j FROM cut UNION SELECT s, b FROM cut)
SELECT p_partkey AS part, (dense_rank() OVER (PARTITION BY p_partkey ORDER BY j) - 1)::BIGINT AS k, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM part JOIN ends ON ends.s = p_size JOIN spots USING (s, j)""")
def drawing_splines(spark, d):
    """Parts as cubic splines of one span; all points of their samples."""
    size = _number("p_size")
    marks = ["0 SECTION 2 ENTITIES 0 SPLINE 70 8 71 3 72 8 73 4 74 0 40 0 40 0 40 0 40 0 40 1 40 1 40 1 40 1 10 0 20 0 10 0 20 2 10 ", (F.col("p_size").cast("long") * 2).cast("string"), " 20 0 10 ", size, " 20 ", (F.col("p_size").cast("long") * 2).cast("string"), " 0 ENDSEC 0 EOF"]
    text = F.replace(F.concat(*[F.lit(m) if isinstance(m, str) else m for m in marks]), F.lit(" "), F.lit("\n"))
    found = curve_samples.sampled_curves(dxf_geometry.curves(scanners.drawing_entities(_file(table(spark, d, "part"), "p_partkey", text))))
    points = found.select(F.col("package_id").cast("long").alias("part"), F.posexplode("points").alias("k", "p"))
    return points.select("part", F.col("k").cast("long").alias("k"), (F.round(F.col("p")[0], 6) + 0.0).alias("x"), (F.round(F.col("p")[1], 6) + 0.0).alias("y"))


_BOX = [(0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7)]


@register(f"""WITH p AS (SELECT DISTINCT p_size::DOUBLE AS s FROM part), v AS (SELECT s, i, x * s AS x, y * 2.0::DOUBLE AS y, z * 1.0::DOUBLE AS z FROM p, (VALUES (0, 0, 0, 0), (1, 1, 0, 0), (2, 1, 1, 0), (3, 0, 1, 0), (4, 0, 0, 1), (5, 1, 0, 1), (6, 1, 1, 1), (7, 0, 1, 1)) t(i, x, y, z)),
c AS (SELECT f, k, q[k + 1] AS i, q[(k + 1) % 4 + 1] AS j FROM (VALUES {', '.join(f'({k}, {list(q)})' for k, q in enumerate(_BOX))}) t(f, q), range(0, 4) r(k)),
fp AS (SELECT s, f, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM c JOIN v USING (i) GROUP BY ALL),
e AS (SELECT fp.s, least(c.i, c.j) AS a, greatest(c.i, c.j) AS b, sum(fp.x) AS x, sum(fp.y) AS y, sum(fp.z) AS z FROM c JOIN fp USING (f) GROUP BY ALL),
ep AS (SELECT e.s, e.a, e.b, (row_number() OVER (PARTITION BY e.s ORDER BY e.a, e.b) - 1) AS n, (v.x + w.x) / 2 AS mx, (v.y + w.y) / 2 AS my, (v.z + w.z) / 2 AS mz, (v.x + w.x + e.x) / 4 AS x, (v.y + w.y + e.y) / 4 AS y, (v.z + w.z + e.z) / 4 AS z FROM e JOIN v ON v.s = e.s AND v.i = e.a JOIN v w ON w.s = e.s AND w.i = e.b),
q AS (SELECT fp.s, c.i, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM c JOIN fp USING (f) GROUP BY ALL), r AS (SELECT ep.s, v.i, avg(mx) AS x, avg(my) AS y, avg(mz) AS z FROM v JOIN ep ON ep.s = v.s AND v.i IN (ep.a, ep.b) GROUP BY ALL),
n AS (SELECT v.s, v.i AS vertex, (q.x + 2 * r.x) / 3 AS x, (q.y + 2 * r.y) / 3 AS y, (q.z + 2 * r.z) / 3 AS z FROM v JOIN q USING (s, i) JOIN r USING (s, i) UNION ALL SELECT s, 8 + n, x, y, z FROM ep UNION ALL SELECT s, 20 + f, x, y, z FROM fp)
SELECT p_partkey AS part, vertex::BIGINT AS vertex, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM part JOIN n ON n.s = p_size""")
def mesh_subdivision(spark, d):
    """Parts as boxes in subdivision meshes; the vertices after one step."""
    size = _number("p_size")
    places = [(0, 0, 0), (1, 0, 0), (1, 2, 0), (0, 2, 0), (0, 0, 1), (1, 0, 1), (1, 2, 1), (0, 2, 1)]
    marks = ["0 SECTION 2 ENTITIES 0 MESH 91 1 92 8"]
    for x, y, z in places:
        marks += [" 10 ", size if x else "0", f" 20 {y} 30 {z}"]
    marks += [" 93 30" + "".join(" 90 4" + "".join(f" 90 {v}" for v in q) for q in _BOX) + " 94 0 0 ENDSEC 0 EOF"]
    text = F.replace(F.concat(*[F.lit(m) if isinstance(m, str) else m for m in marks]), F.lit(" "), F.lit("\n"))
    entities = scanners.drawing_entities(_file(table(spark, d, "part"), "p_partkey", text))
    vertices, faces = (stored(rows, "meshes") for rows in dxf_geometry.subdivision_meshes(entities))
    points, _ = subdivision.subdivide(vertices, faces, dxf_geometry.KEYS)
    return points.select(F.col("package_id").cast("long").alias("part"), F.col("vertex").cast("long").alias("vertex"), *[(F.round(c, 6) + 0.0).alias(c) for c in "xyz"])


@register("""SELECT p_partkey AS part, e AS element, k, round(CASE k WHEN 0 THEN 0.0 WHEN 1 THEN p_size - d ELSE p_size - d END, 6) + 0.0 AS x, round(CASE k WHEN 2 THEN 2 * p_size ELSE d END, 6) + 0.0 AS y FROM part, (VALUES (0::BIGINT, 0.5::DOUBLE), (1, -0.25)) v(e, d), (VALUES (0::BIGINT), (1), (2)) t(k)""")
def drawing_multilines(spark, d):
    """Parts as multilines of two elements around one corner; all points of both lines."""
    size, twice = _number("p_size"), (F.col("p_size").cast("long") * 2).cast("string")
    marks = ["0 SECTION 2 ENTITIES 0 MLINE 2 WALL 40 1 70 1 71 0 72 3 73 2 11 0 21 0 31 0 13 0 23 1 33 0 74 1 41 0.5 74 1 41 -0.25 11 ", size, " 21 0 31 0 13 -1 23 1 33 0 74 2 41 0.5 41 7 74 1 41 -0.25 11 ", size, " 21 ", twice, " 31 0 13 -1 23 0 33 0 74 1 41 0.5 74 1 41 -0.25 0 ENDSEC 0 EOF"]
    text = F.replace(F.concat(*[F.lit(m) if isinstance(m, str) else m for m in marks]), F.lit(" "), F.lit("\n"))
    lines = dxf_geometry.multilines(scanners.drawing_entities(_file(table(spark, d, "part"), "p_partkey", text)))
    points = lines.select(F.col("package_id").cast("long").alias("part"), F.col("element").cast("long").alias("element"), F.posexplode("points").alias("k", "p"))
    return points.select("part", "element", F.col("k").cast("long").alias("k"), *[(F.round(F.col("p")[k], 6) + 0.0).alias(c) for k, c in enumerate("xy")])


def _step(spark, d):
    o = table(spark, d, "orders")
    marks = ["ISO-10303-21;HEADER;ENDSEC;DATA;#1=IFCWALL('", F.col("o_orderpriority"), "',#2);#2=IFCPROPERTYSINGLEVALUE('Status',$,IFCLABEL('", F.col("o_orderstatus"), "'),$);#3=IFCRELAGGREGATES(#1,#", (F.col("o_orderkey") % 5 + 1).cast("string"), ");ENDSEC;END-ISO-10303-21;"]
    return scanners.step_instances(_file(o, "o_orderkey", F.concat(*[F.lit(m) if isinstance(m, str) else m for m in marks])))


@register("""SELECT o_orderkey AS package_id, id, class AS original_class, CASE id WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 2 END END AS n_refs FROM orders, (VALUES (1, 'IFCWALL'), (2, 'IFCPROPERTYSINGLEVALUE'), (3, 'IFCRELAGGREGATES')) v(id, class)""")
def step_scan(spark, d):
    return _step(spark, d).select(F.col("package_id").cast("long").alias("package_id"), F.col("id").cast("int").alias("id"), "original_class", F.size("refs").alias("n_refs"))


@register("""SELECT o_orderkey AS package_id, 'property' AS kind, 'Status' AS name, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'aggregation', '3', '1' FROM orders UNION ALL SELECT o_orderkey, 'aggregation', '3', (o_orderkey % 5 + 1)::VARCHAR FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, 'dangling', '3', (o_orderkey % 5 + 1)::VARCHAR FROM orders WHERE o_orderkey % 5 > 2""")
def model_scan(spark, d):
    """Properties, relations and dangling references of the models of all orders."""
    found = stored(_step(spark, d).select("package_id", "path", "id", "original_class", "refs", "args", "lacking"), "models")
    row = lambda rows, kind, name, value: rows.select(F.col("package_id").cast("long").alias("package_id"), F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"), F.col(value).cast("string").alias("value"))
    relations = ifc_model.ifc_relations(found)
    return row(ifc_model.ifc_properties(found), "property", "name", "value").union(row(relations, "aggregation", "id", "ref")).union(row(scanners.dangling_instances(found), "dangling", "id", "ref"))


@register("""SELECT o_orderkey AS package_id, 1 AS element, 'Pset, a' AS set_name, name, measure, CASE name WHEN 'Status' THEN o_orderpriority || ', ''x''' ELSE value END AS value, origin FROM orders, (VALUES ('Status', 'IFCLABEL', NULL, 'occurrence'), ('N', NULL, '-', 'occurrence'), ('Kinds', 'IFCLABEL', 'a, b|c', 'type'), ('Load', 'IFCREAL', '2.|-|1.', 'type')) v(name, measure, value, origin)""")
def model_properties(spark, d):
    """Orders as models: a wall with a set of its own and one of its type, with commas, quotes and ``$`` in names, descriptions and values."""
    marks = ["ISO-10303-21;HEADER;ENDSEC;DATA;#1=IFCWALL('g',#9,'W, (1)',$,$,$,$,$);#2=IFCWALLTYPE('t',#9,'T',$,$,(#6),$,$,$,.SOLIDWALL.);#3=IFCPROPERTYSINGLEVALUE('Status','d, ''e''',IFCLABEL('", F.col("o_orderpriority"), ", ''x'''),$);"]
    marks += ["#4=IFCPROPERTYSINGLEVALUE('N','d, e',$,$);#5=IFCPROPERTYSET('p',#9,'Pset, a',$,(#3,#4));#6=IFCPROPERTYSET('q',#9,'Pset, a','x',(#7,#8,#12));#7=IFCPROPERTYSINGLEVALUE('Status',$,IFCLABEL('type'),$);#8=IFCPROPERTYENUMERATEDVALUE('Kinds',$,(IFCLABEL('a, b'),IFCLABEL('c')),$);"]
    marks += ["#9=IFCOWNERHISTORY($);#10=IFCRELDEFINESBYPROPERTIES('r',#9,$,$,(#1),#5);#11=IFCRELDEFINESBYTYPE('s',#9,$,$,(#1),#2);#12=IFCPROPERTYBOUNDEDVALUE('Load','(',IFCREAL(2.),$,$,IFCREAL(1.));ENDSEC;END-ISO-10303-21;"]
    text = F.concat(*[F.lit(m) if isinstance(m, str) else m for m in marks])
    found = ifc_model.file_properties(_file(table(spark, d, "orders"), "o_orderkey", text))
    value = F.array_join("values", "|", "-")
    return found.select(F.col("package_id").cast("long").alias("package_id"), F.col("element").cast("int").alias("element"), "set_name", "name", "measure", value.alias("value"), "origin")


@register("""SELECT s_suppkey AS package_id, s_nationkey AS x, t AS triangle, b, c FROM supplier, (VALUES (1, 1, 2), (2, 2, 3)) v(t, b, c)""")
def mesh_scan(spark, d):
    """Suppliers as one quad, counted back from its last vertex; the triangles with the place of their first corner."""
    n = _number("s_nationkey")
    text = F.concat(F.lit("v "), n, F.lit(" 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf -4 -3/1 -2//2 4\n"))
    vertices, faces = scanners.obj_mesh(_file(table(spark, d, "supplier"), "s_suppkey", text))
    corner = vertices.select("package_id", "path", F.col("vertex").alias("a"), F.col("x").cast("int").alias("x"))
    return faces.join(corner, ["package_id", "path", "a"]).select(F.col("package_id").cast("long").alias("package_id"), "x", (F.col("c") - 1).cast("int").alias("triangle"), F.col("b").cast("int").alias("b"), F.col("c").cast("int").alias("c"))


@register("""SELECT s_suppkey AS package_id, 110 AS entity_type, s_nationkey AS level, 2 AS form, 'LINE' AS label, false AS is_external, true AS is_paired FROM supplier UNION ALL SELECT s_suppkey, 416, 0, 0, '', true, s_suppkey % 2 = 0 FROM supplier""")
def directory_scan(spark, d):
    card = lambda text, n: F.concat(F.rpad(text, 72, " "), F.lit("D" + str(n).rjust(7)))
    plain = lambda *v: F.lit("".join(str(x).rjust(8) for x in v))
    level = F.lpad(_number("s_nationkey"), 8, " ")
    last = F.when(F.col("s_suppkey") % 2 == 0, 416).otherwise(417).cast("string")
    cards = [card(F.concat(plain(110, 1, 0, 0), level), 1), card(F.lit("".join(str(x).rjust(8) for x in (110, 0, 0, 1, 2)) + " " * 16 + "LINE"), 2), card(plain(416, 2), 3), card(F.lpad(last, 8, " "), 4)]
    found = scanners.iges_directory(_file(table(spark, d, "supplier"), "s_suppkey", F.concat_ws("\n", *cards)))
    return found.select(F.col("package_id").cast("long").alias("package_id"), "entity_type", "level", "form", "label", "is_external", "is_paired")


@register("""SELECT s_suppkey AS package_id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'PGM' END AS format, CASE WHEN s_suppkey % 3 <> 0 THEN (s_nationkey + 1) * 1000 ELSE 0 END AS width, CASE WHEN s_suppkey % 3 <> 0 THEN 7000 ELSE 0 END AS height, CASE WHEN s_suppkey % 3 = 0 THEN 'IMAGE_FORMAT_UNSUPPORTED' WHEN s_nationkey >= 14 THEN 'IMAGE_TOO_LARGE' END AS error FROM supplier""")
def raster_scan(spark, d):
    head = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "P9").otherwise("P5"), F.lit("\n# scan\n"), ((F.col("s_nationkey") + 1) * 1000).cast("string"), F.lit(" 7000 255\n"))
    found = scanners.raster_headers(_file(table(spark, d, "supplier"), "s_suppkey", head))
    return found.select(F.col("package_id").cast("long").alias("package_id"), "format", F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"), "error")


@register("""WITH p AS (SELECT p_partkey AS part, p_size % 5 + 1 AS k, p_size % 2 = 0 AS joined FROM part)
SELECT part, 0 AS "left", 0 AS top, 4 * k - 3 AS width, 20 AS height, (20 * k + 3 * (k - 1))::BIGINT AS pixels FROM p WHERE joined UNION ALL SELECT part, (4 * i)::INT, 0, 1, 20, 20 FROM p, range(0, 5) r(i) WHERE i < k AND NOT joined""")
def raster_dark_regions(spark, d):
    """Parts as bitmaps of bars, joined by a line or not; their dark regions over strips of six rows."""
    k = (F.col("p_size") % 5 + 1).cast("int")
    bars = F.rpad(F.repeat(F.lit("1000"), k), 40, "0")
    line = F.when(F.col("p_size") % 2 == 0, F.rpad(F.repeat(F.lit("1"), k * 4 - 3), 40, "0")).otherwise(bars)
    text = F.concat(F.lit("P1\n# bars\n40 20\n"), F.array_join(F.array(*[bars] * 9, line, *[bars] * 10), "\n"))
    strips = rasters.dark_strips(_file(table(spark, d, "part"), "p_partkey", text), rows=6)
    found = rasters.raster_regions(stored(strips, "strips"))
    return found.select(F.col("package_id").cast("long").alias("part"), "left", "top", "width", "height", "pixels")


_SHIFT = [("a", "GRS80", "WGS84", 1.0, 1.0, -1.0), ("b", "INTL", "WGS84", -87.0, -98.0, -121.0)]


@register("""WITH o(op, a1, f1, a2, f2, dx, dy, dz) AS (VALUES ('a', 6378137.0::DOUBLE, 298.257222101::DOUBLE, 6378137.0::DOUBLE, 298.257223563::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, -1.0::DOUBLE), ('b', 6378388.0, 297.0, 6378137.0, 298.257223563, -87.0, -98.0, -121.0)),
p AS (SELECT c_custkey AS solution_id, CASE c_nationkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS op, (c_custkey % 181 - 90)::DOUBLE AS lat, (c_custkey % 400 - 190)::DOUBLE AS lon, c_acctbal AS h FROM customer),
x AS (SELECT p.*, a2, (2 - 1 / f2) / f2 AS g, radians(lat) AS phi, radians(lon) AS lam, a1 / sqrt(1 - (2 - 1 / f1) / f1 * sin(radians(lat)) ** 2) AS n, (2 - 1 / f1) / f1 AS e, dx, dy, dz FROM p LEFT JOIN o USING (op)),
y AS (SELECT *, (n + h) * cos(phi) * cos(lam) + dx AS x, (n + h) * cos(phi) * sin(lam) + dy AS y, (n * (1 - e) + h) * sin(phi) + dz AS z FROM x),
z AS (SELECT *, list_reduce([0, 0, 0, 0, 0, 0, 0, 0, 0]::DOUBLE[], lambda t, i: atan2(z + g * a2 / sqrt(1 - g * sin(t) ** 2) * sin(t), sqrt(x * x + y * y)), atan2(z, sqrt(x * x + y * y) * (1 - g))) AS b FROM y)
SELECT solution_id, op AS operation_id, CASE WHEN abs(lon) <= 180 THEN round(degrees(b), 9) + 0.0 END AS lat, CASE WHEN abs(lon) <= 180 AND abs(lat) < 90 THEN round(degrees(atan2(y, x)), 9) + 0.0 END AS lon,
  CASE WHEN abs(lon) <= 180 THEN round(sqrt(x * x + y * y) * cos(b) + z * sin(b) - a2 * sqrt(1 - g * sin(b) ** 2), 4) + 0.0 END AS h, CASE WHEN op = 'c' THEN 'CRS_OPERATION_UNKNOWN' WHEN abs(lon) > 180 THEN 'CRS_POINT_INVALID' END AS error FROM z""")
def datum_shifts(spark, d):
    """Customers as points on the globe under two shifts, and one that no registry has."""
    op = F.when(F.col("c_nationkey") % 3 == 0, "a").when(F.col("c_nationkey") % 3 == 1, "b").otherwise("c")
    k = F.col("c_custkey")
    points = table(spark, d, "customer").select(k.alias("solution_id"), F.lit(0).alias("place"), op.alias("operation_id"), (k % 181 - 90).cast("double").alias("lat"), (k % 400 - 190).cast("double").alias("lon"), F.col("c_acctbal").alias("h"))
    schema = "operation_id string, source_ellipsoid string, target_ellipsoid string, dx double, dy double, dz double"
    known = spark.createDataFrame(_SHIFT, schema).withColumns({"required_grids": F.array().cast("array<string>"), "maximum_points": F.lit(100_000), "horizontal_tolerance": F.lit(1e-9), "vertical_tolerance": F.lit(1e-6)})
    found = datum.shifted_points(points, known)
    # the longitude of a pole is whatever the arithmetic makes of it, and so is its way back
    pole = F.abs("lat") == 90
    error = F.when(pole & (F.col("error") == "CRS_ROUND_TRIP_TOLERANCE_EXCEEDED"), F.lit(None)).otherwise(F.col("error"))
    good = ~F.coalesce(error.isin("CRS_POINT_INVALID", "CRS_OPERATION_UNKNOWN"), F.lit(False))
    told = lambda c, n: F.when(good, F.round(c, n) + 0.0)
    return found.select("solution_id", "operation_id", told("new_lat", 9).alias("lat"), F.when(~pole, told("new_lon", 9)).alias("lon"), told("new_h", 4).alias("h"), error.alias("error"))


@register("""SELECT p_partkey AS part, 'trimmed_curve' AS kind, k, round(1 + p_size * cos(pi() / 2 * k / 16), 6) + 0.0 AS x, round(2 + p_size * sin(pi() / 2 * k / 16), 6) + 0.0 AS y FROM part, range(0, 17) r(k)
UNION ALL SELECT p_partkey, 'mapped_item', k, p_size + CASE k WHEN 0 THEN 4.0 ELSE 0.0 END, CASE k WHEN 0 THEN -2.0 ELSE 0.0 END FROM part, range(0, 2) r(k)""")
def model_plane_geometry(spark, d):
    """Parts as models: a quarter of a circle, and a line mapped with a turn, a shift and a scale; all points."""
    size = _number("p_size")
    marks = ["ISO-10303-21;HEADER;ENDSEC;DATA;#1=IFCCARTESIANPOINT((1.,2.));#2=IFCAXIS2PLACEMENT2D(#1,$);#3=IFCCIRCLE(#2,", size, ".);#4=IFCTRIMMEDCURVE(#3,(IFCPARAMETERVALUE(0.)),(IFCPARAMETERVALUE(1.5707963267948966)),.T.,.PARAMETER.);#5=IFCCARTESIANPOINT((0.,0.));"]
    marks += ["#6=IFCPOLYLINE((#5,#1));#7=IFCSHAPEREPRESENTATION(#99,'Plan','Curve2D',(#6));#8=IFCREPRESENTATIONMAP(#2,#7);#9=IFCDIRECTION((0.,1.));#10=IFCCARTESIANPOINT((", size, ".,0.));#11=IFCCARTESIANTRANSFORMATIONOPERATOR2D(#9,$,#10,2.);#12=IFCMAPPEDITEM(#8,#11);ENDSEC;END-ISO-10303-21;"]
    text = F.concat(*[F.lit(m) if isinstance(m, str) else m for m in marks])
    found = ifc_plane.file_geometry(_file(table(spark, d, "part"), "p_partkey", text)).filter("kind in ('trimmed_curve', 'mapped_item')")
    points = found.select(F.col("package_id").cast("long").alias("part"), "kind", F.posexplode(F.flatten("paths")).alias("k", "p"))
    return points.select("part", "kind", F.col("k").cast("long").alias("k"), *[(F.round(F.col("p")[k], 6) + 0.0).alias(c) for k, c in enumerate("xy")])


@register("SELECT page_id, sha256(encode(html)) AS sha256, octet_length(encode(html))::BIGINT AS bytes, 'embedded' AS embedding_policy, 'sources/' || sha256(encode(html)) AS storage_ref FROM pages")
def opaque_register(spark, d):
    pages = table(spark, d, "pages").select(F.lit("p").alias("package_id"), F.col("page_id").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"))
    return scanners.register_opaque(pages, "embedded").select(F.col("path").cast("long").alias("page_id"), "sha256", "bytes", "embedding_policy", "storage_ref")


@register("""WITH e AS (SELECT o_custkey AS package_id, o_orderkey::VARCHAR AS path, o_orderkey % 4 = 0 AS gone, o_orderkey % 9 = 0 AS other, o_orderstatus = 'F' AS root FROM orders)
SELECT package_id, 'BUNDLE_ROOT_INVALID' AS code, '' AS path FROM e GROUP BY 1 HAVING count(*) FILTER (root) <> 1 UNION ALL SELECT package_id, 'BUNDLE_TOO_MANY_ENTRIES', '' FROM e GROUP BY 1 HAVING count(*) > 32
UNION ALL SELECT package_id, 'BUNDLE_ENTRY_MISSING', path FROM e WHERE gone UNION ALL SELECT package_id, 'BUNDLE_ENTRY_MISMATCH', path FROM e WHERE other AND NOT gone UNION ALL SELECT o_custkey, 'BUNDLE_FILE_UNLISTED', 'x' || o_orderkey FROM orders WHERE o_orderkey % 25 = 0""")
def bundle_check(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("package_id"), k.cast("string").alias("path"), k, "o_orderstatus", k.alias("bytes"), F.sha2("o_orderstatus", 256).alias("sha256"))
    entries = o.withColumn("role", F.when(F.col("o_orderstatus") == "F", "root").otherwise("part"))
    found = o.filter("o_orderkey % 4 <> 0").withColumn("bytes", F.when(k % 9 == 0, -1).otherwise(k)).select("package_id", "path", "bytes", "sha256")
    beside = o.filter("o_orderkey % 25 = 0").select("package_id", F.concat(F.lit("x"), "path"), "bytes", "sha256")
    return scanners.check_bundles(entries, found.union(beside))


@register("SELECT page_id, sha256(encode(nfc_normalize(html))) AS nfc, sha256(encode(translate(to_base64(encode(html)), '+/=', '-_'))) AS code FROM pages")
def text_forms(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(canon.nfc("html"), 256).alias("nfc"), F.sha2(canon.base64url(F.encode("html", "UTF-8")), 256).alias("code"))


@register("""WITH s AS (SELECT o_orderkey, o_orderstatus, l_linenumber * 100000000 + l_suppkey * 100 + l_quantity::BIGINT AS place, '## `r' || l_linenumber || '` (entity)' || chr(10) || chr(10) || 'Authority: `lines:' || l_suppkey || '`' || chr(10) || chr(10) || '```json' || chr(10) || '{"q":' || l_quantity::BIGINT || '}' || chr(10) || '```' || chr(10) AS section FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
c AS (SELECT o_orderkey AS package_id, any_value(o_orderstatus) AS status, count(*) AS n, '# Context chunk 1' || chr(10) || chr(10) || string_agg(section, '' ORDER BY place, section) AS content FROM s GROUP BY 1),
i AS (SELECT package_id, (octet_length(encode(content)) + 3) // 4 AS held,
  '# Context index' || chr(10) || chr(10) || '- Package: `' || package_id || '`' || chr(10) || '- Digest: `' || status || '`' || chr(10) || '- Profile: agent' || chr(10) || '- Token budget: 40000' || chr(10) || '- Token estimate: ' AS head,
  chr(10) || '- Records in the context: ' || n || chr(10) || '- Records left out: 0' || chr(10) || '- Capabilities: `{}`' || chr(10) || '- Losses: `[]`' || chr(10) || chr(10) || '## Chunks' || chr(10) || chr(10) || '- [chunk-001.md](chunk-001.md)' || chr(10) || chr(10) || 'This is a selection; exact questions go to the records themselves.' || chr(10) AS foot FROM c),
x AS (SELECT package_id, head || (held + (octet_length(encode(head)) + 6 + octet_length(encode(foot)) + 3) // 4) || foot AS content FROM i)
SELECT package_id, 'context/chunk-001.md' AS path, content, ((octet_length(encode(content)) + 3) // 4)::BIGINT AS tokens FROM c UNION ALL SELECT package_id, 'context/index.md', content, ((octet_length(encode(content)) + 3) // 4)::BIGINT FROM x""")
def context_render(spark, d):
    """Orders as packages and their lines as sections; each order has one chunk."""
    li = table(spark, d, "lineitem").withColumn("package_id", F.col("l_orderkey"))
    place = F.col("l_linenumber").cast("long") * 10**8 + F.col("l_suppkey").cast("long") * 100 + F.col("l_quantity").cast("long")
    body = F.format_string('{"q":%d}', F.col("l_quantity").cast("long"))
    text = context.section(F.concat(F.lit("r"), _number("l_linenumber")), F.lit("entity"), F.lit("lines"), F.col("l_suppkey").cast("long"), body)
    sections = li.select("package_id", place.alias("place"), _number("l_linenumber").alias("record_id"), text.alias("section"), F.count("*").over(Window.partitionBy("package_id")).alias("total")).withColumn("size", F.octet_length("section").cast("long"))
    heads = li.select("package_id").distinct().join(table(spark, d, "orders").select(F.col("o_orderkey").alias("package_id"), F.col("o_orderstatus").alias("logical_digest")), "package_id")
    heads = heads.withColumns({"capabilities": F.lit("{}"), "losses": F.lit("[]")})
    return context.render(sections, heads)
