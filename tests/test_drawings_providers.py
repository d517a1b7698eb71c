import json
import math
import struct

import numpy as np
from pyspark.sql import functions as F

from trussline.operators import drawings, providers


def test_nested_inserts(spark):
    def m(x, scale=1.0):
        return [scale, 0, 0, x, 0, scale, 0, 0, 0, 0, scale, 0, 0, 0, 0, 1.0]

    data = [("model", "door", m(10.0)), ("model", "door", m(20.0)), ("door", "knob", m(1.0, 2.0)), ("knob", "door", m(0.0)), ("other", "x", m(0.0))]
    edges = spark.createDataFrame([(a, b, [float(x) for x in c]) for a, b, c in data], "parent string, child string, matrix array<double>")
    got = drawings.walk(edges, spark.createDataFrame([("model",)], "root string"), 32)
    rows = sorted((r.node, r.depth, r.status, r.matrix[3], r.matrix[0]) for r in got.collect())
    assert rows == [("door", 1, "ok", 10.0, 1.0), ("door", 1, "ok", 20.0, 1.0), ("door", 3, "cycle", 11.0, 2.0), ("door", 3, "cycle", 21.0, 2.0), ("knob", 2, "ok", 11.0, 2.0), ("knob", 2, "ok", 21.0, 2.0), ("model", 0, "ok", 0.0, 1.0)]
    assert [r.node for r in drawings.unreached(spark.createDataFrame([("knob",), ("x",)], "node string"), got).collect()] == ["x"]
    chain = spark.createDataFrame([(str(k), str(k + 1), [float(x) for x in m(0.0)]) for k in range(6)], "parent string, child string, matrix array<double>")
    deep = drawings.walk(chain, spark.createDataFrame([("0",)], "root string"), 3)
    assert sorted((r.depth, r.status) for r in deep.collect()) == [(0, "ok"), (1, "ok"), (2, "ok"), (3, "ok"), (4, "too_deep")]


def test_curves(spark):
    one = spark.range(1)
    p = one.select(drawings.arc_points(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(0.0), F.lit(math.pi), 2).alias("p")).first().p
    assert np.allclose(p, [[4, 2], [1, 5], [-2, 2]])
    c = one.select(drawings.circle_through(*[F.lit(float(x)) for x in (1, 0, 0, 1, -1, 0)]).alias("c"), drawings.circle_through(*[F.lit(float(x)) for x in (0, 0, 1, 1, 2, 2)]).alias("n")).first()
    assert np.allclose([c.c.x, c.c.y, c.c.radius], [0, 0, 1]) and c.n is None
    m = one.select(drawings.insert_matrix(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(2.0), F.lit(90.0)).alias("m")).first().m
    assert np.allclose(np.array(m).reshape(4, 4) @ [1, 0, 0, 1], [1, 4, 3, 1])


def test_glb_and_svg(spark):
    meshes = spark.createDataFrame([(1, [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 2.0]], [[0, 1, 2]]), (2, [], []), (3, None, None)], "mesh_id int, vertices array<array<double>>, faces array<array<int>>")
    files = {r.mesh_id: r.glb for r in drawings.glb_files(meshes).collect()}
    data = bytes(files[1])
    magic, version, size = struct.unpack_from("<4sII", data)
    length = struct.unpack_from("<I", data, 12)[0]
    document = json.loads(data[20 : 20 + length])
    assert (magic, version, size) == (b"glTF", 2, len(data)) and document["accessors"][0]["max"] == [1.0, 2.0, 0.0] and files[2] is None and files[3] is None
    assert struct.unpack_from("<9f", data, 28 + length)[6:] == (0.0, 2.0, -1.0)
    polygons = spark.createDataFrame([(1, 2, "c,d"), (1, 1, "a,b")], "mesh_id int, place int, points string")
    assert '<polygon points="a,b"/><polygon points="c,d"/>' in drawings.svg_previews(polygons).first().svg


def test_paths(spark):
    ops = spark.createDataFrame([(1, k, o) for k, o in enumerate("m l S m f l".split())] + [(2, 0, "m")], "page int, seq int, op string")
    got = sorted((r.page, r.seq, r.path) for r in drawings.group_paths(ops, ["page"]).collect())
    assert got == [(1, 0, 0), (1, 1, 0), (1, 2, 0), (1, 3, 1), (1, 4, 1), (1, 5, None), (2, 0, None)]


def test_statement_is_independent_of_the_form(spark):
    docs = ['{"package_form":"zip","a":1,"b":{"x":1}}', '{"b":{"x":1},"package_form":"directory","a":1}', '{"b":{"x":2},"a":1}']
    got = [r.d for r in spark.createDataFrame([(d,) for d in docs], "m string").select(providers.statement_digest(F.col("m")).alias("d")).collect()]
    assert got[0] == got[1] != got[2]


def test_exchange_files(spark):
    raw = [(1, "PRODUCT", "#1=PRODUCT('it''s','n','',(#2));"), (5, "NEXT_ASSEMBLY_USAGE_OCCURRENCE", "#5=NEXT_ASSEMBLY_USAGE_OCCURRENCE('a','b','',#10,#11,$);")]
    rows = spark.createDataFrame([("p", *r) for r in raw], "package_id string, id long, original_class string, raw string")
    assert [r.label for r in providers.product_labels(rows).collect()] == ["it's"]
    assert [(r.parent, r.child) for r in providers.assembly_relations(rows).collect()] == [(10, 11)]


def test_responses(spark):
    requests = spark.createDataFrame([("q1", "ocr")], "request_id string, provider_id string")
    sha = "2c26b46b68ffc68ff99b453c1d30413413422d706483bfa0f98a5e886266e7ae"  # of foo
    rows = [("ok", "q1", "ocr", "foo", sha, "ocr"), ("a", "q2", "ocr", "foo", sha, "ocr"), ("b", "q1", "x", "foo", sha, "x"), ("c", "q1", "ocr", "bar", sha, None), ("d", "q1", "ocr", '{"p":"/home/me/x"}', "z", "ocr")]
    responses = spark.createDataFrame(rows, "response_id string, request_id string, provider_id string, payload string, payload_sha256 string, attested_provider string")
    artifacts = spark.createDataFrame([("ok", "foo", sha), ("a", "foo", "bad"), ("a", "bar", "bad")], "response_id string, content string, sha256 string")
    got = sorted(map(tuple, providers.check_responses(requests, responses, artifacts).collect()))
    assert got == [("a", "RESPONSE_ARTIFACT_MISMATCH"), ("a", "RESPONSE_REQUEST_UNKNOWN"), ("b", "RESPONSE_PROVIDER_MISMATCH"), ("c", "RESPONSE_ATTESTATION_MISMATCH"), ("c", "RESPONSE_PAYLOAD_MISMATCH"), ("d", "RESPONSE_HOST_PATH"), ("d", "RESPONSE_PAYLOAD_MISMATCH")]


def test_states(spark):
    cases = {"$": "explicit_null", "*": "not_applicable", ".U.": "unknown", ".T.": "known", "'a''b'": "known", "1.5E3": "known", "IFCLABEL('x')": "known", "(#1,#2)": "unsupported", None: "explicit_null"}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", drawings.attribute_state(F.col("t")).alias("s")).collect()
    assert {r.t: r.s.state for r in rows} == cases and {r.t: r.s.value for r in rows}["'a''b'"] == "a'b"
    assert all((r.s.reason_code is None) == (r.s.state == "known") for r in rows)
    lost = providers.candidate_records(spark.createDataFrame([("p", "c1")], "package_id string, candidate_id string"), spark.createDataFrame([("p", "c1", "c2"), ("p", "c2", "c1")], "package_id string, subject_id string, object_id string"))
    assert [r.subject for r in lost.collect()] == ["c2"]
