import math
import random

import numpy as np
from pyspark.sql import functions as F

from trussline.functions import values
from trussline.operators import geometry, graph, inference


def test_similarity(spark):
    r = np.random.default_rng(1)
    q, _ = np.linalg.qr(r.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    data = []
    for key, n, flip in (("good", 6, 1), ("mirror", 6, -1), ("few", 2, 1), ("line", 5, 1), ("noise", 9, 1)):
        pts = r.normal(size=(n, 3)) if key != "line" else np.outer(np.arange(n), [1.0, 2, 3])
        to = 3 * pts @ q.T * [1, 1, flip] + [10, 20, 30] + (r.normal(size=(n, 3)) if key == "noise" else 0)
        data += [(key, *map(float, a), *map(float, b)) for a, b in zip(pts, to)]
    got = {x.k: x for x in geometry.similarity(spark.createDataFrame(data, "k string, x double, y double, z double, tx double, ty double, tz double"), "k", 1e-5).collect()}
    assert {k: v.status for k, v in got.items()} == {"good": "known", "mirror": "reflection", "few": "insufficient", "line": "collinear", "noise": "tolerance_exceeded"}
    m = np.array(got["good"].matrix).reshape(4, 4)
    assert math.isclose(got["good"].scale, 3, rel_tol=1e-9) and np.allclose(m[:3, :3], 3 * q) and np.allclose(m[:3, 3], [10, 20, 30])


def test_matrices(spark):
    r = np.random.default_rng(2)
    rows = []
    for k in range(6):
        m = r.normal(size=(4, 4)) + 3 * np.eye(4)
        inv = np.linalg.inv(m) * (1 if k % 2 else 1.1)
        rows.append((k, m.ravel().tolist(), inv.ravel().tolist() if k != 5 else [1.0]))
    got = spark.createDataFrame(rows, "k int, m array<double>, i array<double>").select("k", values.inverse_matches(F.col("m"), F.col("i")).alias("ok"), values.matrix_product(F.col("m"), F.col("m")).alias("p"))
    for row in got.collect():
        assert row.ok == (row.k in (1, 3))
        m = np.array(rows[row.k][1]).reshape(4, 4)
        assert np.allclose(row.p, (m @ m).ravel())


def test_boxes_and_pages(spark):
    r = random.Random(5)
    boxes = []
    for k in range(80):
        x, y = r.randrange(60), r.randrange(60)
        boxes.append((k, float(x), float(y), float(x + r.randrange(1, 40)), float(y + r.randrange(1, 40))))
    want = sorted((o[0], i[0]) for o in boxes for i in boxes if o[0] != i[0] and o[1] <= i[1] and o[2] <= i[2] and i[3] <= o[3] and i[4] <= o[4])
    df = spark.createDataFrame(boxes, "id int, x0 double, y0 double, x1 double, y1 double")
    assert sorted((x.outer, x.inner) for x in graph.contained_boxes(df, 16.0).collect()) == want
    turned = spark.createDataFrame([([1, 2, 3, 5], 90), ([1, 2, 3, 5], 180), ([1, 2, 3, 5], 270), ([1, 2, 3, 5], 0)], "b array<int>, d int")
    assert [list(x[0]) for x in turned.select(values.rotated_box(F.col("b"), F.col("d"), F.lit(10), F.lit(20))).collect()] == [[15, 1, 18, 3], [7, 15, 9, 18], [2, 7, 5, 9], [1, 2, 3, 5]]
    fans = spark.createDataFrame([(2,), (3,), (5,)], "n int").select(values.fan(F.col("n"))).collect()
    assert [list(map(list, x[0])) for x in fans] == [[], [[0, 1, 2]], [[0, 1, 2], [0, 2, 3], [0, 3, 4]]]


def test_lineage_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "parent string, child string")
    roots = spark.createDataFrame([("a",), ("x",)], "root string")
    got = sorted(map(tuple, graph.lineage(edges, roots).select("root", "node", "depth").collect()))
    assert got == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("x", "x", 0), ("x", "y", 1)]


def test_layout(spark):
    row = lambda *v: "\t".join(map(str, v))
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    table = [head, row(4, 1, 1, 1, 1, 0, 0, 0, 9, 9, -1, "")] + [row(5, 1, 1, 1, line, word, 10 + 100 * word + line, 20 * line, 30, 10, 90, f"w{line}{word}") for line in (1, 2) for word in (1, 2)] + [row(5, 1, 2, 1, 1, 1, 0, 90, 5, 5, 10, "weak")]
    mixed = [row(5, 1, 1, 1, 2, 1, 0, 0, 5, 5, 90, "b"), row(5, 1, 1, 1, 1, 1, 9, 0, 5, 5, 90, "a\tb")]
    words = inference.words_from_tsv(spark.createDataFrame([("t", "\n".join(table)), ("m", "\r\n".join(mixed))], "page_id string, tsv string"), 50)
    assert sorted((w.page_id, w.reading_order, w.text) for w in words.collect()) == [("m", 0, "b"), ("m", 1, "a\tb"), ("t", 0, "w11"), ("t", 1, "w12"), ("t", 2, "w21"), ("t", 3, "w22")]
    assert dict(map(tuple, inference.reading_order_state(words).collect())) == {"t": "known", "m": "unknown"}
    assert sorted(map(tuple, inference.table_topology(words).collect())) == [("m", "unknown", None), ("t", "known", 2)]
    box = inference.union_boxes(words.filter("page_id = 't'"), ["page_id"]).first()
    assert (box.left, box.top, box.width, box.height, box.n_words) == (111, 20, 131, 30, 4)


def test_raster_rules(spark):
    a = np.full((60, 80), 255, np.uint8)
    a[2:20, 3] = a[2:20, 22] = a[2, 3:23] = a[19, 3:23] = 0  # rectangle
    a[30:37, 13] = a[33, 10:17] = 0  # cross
    for k in (0, 6, 12):  # grid
        a[40 + k, 40:53] = a[40:53, 40 + k] = 0
    a[25, 60:70] = a[24:27, 60] = a[24:27, 69] = 0  # dimension
    a[55, 0:4] = 0  # too small
    rasters = spark.createDataFrame([("r", 80, 60, bytearray(a.tobytes())), ("bad", 9, 9, bytearray(b"x"))], "raster_id string, width int, height int, pixels binary")
    got = sorted((x.kind, x.left, x.top, x.width, x.height) for x in inference.raster_candidates(rasters).collect())
    assert ("error.raster_invalid", None, None, None, None) in got  # the raster whose pixels are too few
    got = [g for g in got if not g[0].startswith("error.")]
    assert got == [("dimension.linear", 60, 24, 10, 3), ("region.rectangle", 3, 2, 20, 18), ("symbol.cross", 10, 30, 7, 7), ("table.grid", 40, 40, 13, 13)]


def test_similarity_keeps_map_coordinates(spark):
    import numpy as np

    from trussline.operators import geometry

    r = np.random.default_rng(2)
    p = r.uniform(-50, 50, (20, 3))
    c, s = np.cos(0.3), np.sin(0.3)
    moved = 1.5 * p @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T + [5e5, 5e6, 120]
    off = moved.copy()
    off[7, 0] += 0.5
    rows = [("good", *a.tolist(), *b.tolist()) for a, b in zip(p, moved)] + [("off", *a.tolist(), *b.tolist()) for a, b in zip(p, off)] + [(None, *a.tolist(), *b.tolist()) for a, b in zip(p, moved)] + [("two", 0.0, 0.0, 0.0, 1.0, 1.0, None)]
    table = spark.createDataFrame(rows, "k string, x double, y double, z double, tx double, ty double, tz double")
    got = {g.k: g for g in geometry.similarity(table, "k", 1e-6).collect()}
    assert got["good"].status == "known" and got["good"].max_misfit < 1e-6 and abs(got["good"].scale - 1.5) < 1e-9
    back = np.array(got["good"].matrix).reshape(4, 4)
    assert np.allclose((back @ np.c_[p, np.ones(20)].T).T[:, :3], moved, atol=1e-6)
    assert got[None].status == "known" and "two" not in got
    assert got["off"].status == "tolerance_exceeded"
    m = np.array(got["off"].matrix).reshape(4, 4)
    assert abs(got["off"].max_misfit - np.linalg.norm((m @ np.c_[p, np.ones(20)].T).T[:, :3] - off, axis=1).max()) < 1e-6


def test_large_boxes_are_filed_under_few_cells(spark):
    import random

    from trussline.operators import graph

    r = random.Random(1)
    boxes = [(k, *(x := (r.uniform(0, 1000), r.uniform(0, 1000))), x[0] + r.choice([1, 5, 90, 3000]), x[1] + r.choice([1, 8, 400])) for k in range(250)]
    boxes += [(900, -1e6, -1e6, 1e6, 1e6), (901, None, 0.0, 1.0, 1.0), (902, 0.0, 0.0, float("inf"), 5.0), (903, 5.0, 5.0, 5.0, 5.0), (904, 1.0, 2.0, 7.0, 8.0), (905, 1.0, 2.0, 7.0, 8.0)]
    table = spark.createDataFrame(boxes, "id long, x0 double, y0 double, x1 double, y1 double")
    fine = [b for b in boxes if None not in b and float("inf") not in b]
    want = {(o[0], i[0]) for o in fine for i in fine if o[0] != i[0] and o[1] <= i[1] and o[2] <= i[2] and i[3] <= o[3] and i[4] <= o[4]}
    out = graph.contained_boxes(table, 4.0)
    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_flat_boxes_are_dealt_out_and_met_by_few_others(spark):
    from trussline.operators import graph

    boxes = [(k, float(k % 7), float(k), float(k % 7 + 500), float(k + 1)) for k in range(2000)]
    boxes += [(k + 5000, float(k % 7 + 20), float(k), float(k % 7 + 30), float(k + 1)) for k in range(0, 2000, 9)]
    table = spark.createDataFrame(boxes, "id long, x0 double, y0 double, x1 double, y1 double")
    on = ["lx", "ly", "cx", "cy"]
    outer, inner = graph.filed_boxes(table, 16.0)
    assert outer.join(inner, on).count() < 20 * len(boxes)
    found = graph.contained_boxes(table, 16.0)
    assert {(r.outer, r.inner) for r in found.collect()} == {(k, k + 5000) for k in range(0, 2000, 9)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_rasters_that_cannot_be_read_give_an_error(spark):
    from trussline.operators import inference

    rows = [(1, 2, 2, bytes(3)), (2, 5000, 1, bytes(5000)), (3, 1, 1, None), (4, 2, 2, b"\xff" * 4)]
    got = inference.raster_candidates(spark.createDataFrame(rows, "raster_id int, width int, height int, pixels binary")).collect()
    assert sorted((g.raster_id, g.kind, g.place) for g in got) == [(1, "error.raster_invalid", None), (2, "error.raster_too_large", None), (3, "error.raster_invalid", None)]
