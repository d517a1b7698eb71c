import numpy as np
from pyspark.sql import functions as F

from tests.test_geometry_files import drawing
from trussline.operators import subdivision
from trussline.sources import dxf_geometry

KEYS = ["package_id", "path", "nth"]


def mesh(spark, points, faces, n=1):
    v = [(f"p{m}", "f", 1, k, *map(float, p)) for m in range(n) for k, p in enumerate(points)]
    f = [(f"p{m}", "f", 1, k, list(q)) for m in range(n) for k, q in enumerate(faces)]
    return spark.createDataFrame(v, "package_id string, path string, nth long, vertex int, x double, y double, z double"), spark.createDataFrame(f, "package_id string, path string, nth long, face int, corners array<int>")


CUBE = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
SIDES = [(0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7)]


def plain(points, faces):
    """One step by dictionaries."""
    points = [np.array(p, float) for p in points]
    middles = [sum(points[v] for v in f) / len(f) for f in faces]
    edges = {}
    for k, f in enumerate(faces):
        for a, b in zip(f, [*f[1:], f[0]]):
            edges.setdefault((min(a, b), max(a, b)), []).append(k)
    names = sorted(edges)
    spots = [(points[a] + points[b]) / 2 if len(edges[a, b]) != 2 else (points[a] + points[b] + sum(middles[k] for k in edges[a, b])) / 4 for a, b in names]
    moved = []
    for v, p in enumerate(points):
        around = [k for k, f in enumerate(faces) if v in f]
        mine = [e for e in names if v in e]
        creases = [e for e in mine if len(edges[e]) != 2]
        half = lambda e: (points[e[0]] + points[e[1]]) / 2
        if mine and not creases:
            p = (sum(middles[k] for k in around) / len(around) + 2 * sum(map(half, mine)) / len(mine) + (len(mine) - 3) * p) / len(mine)
        elif len(creases) == 2:
            p = sum(map(half, creases)) / 4 + p / 2
        moved.append(p)
    n, m = len(points), len(names)
    edge = {e: n + k for k, e in enumerate(names)}
    quads = [(v, edge[min(v, f[(c + 1) % len(f)]), max(v, f[(c + 1) % len(f)])], n + m + k, edge[min(v, f[c - 1]), max(v, f[c - 1])]) for k, f in enumerate(faces) for c, v in enumerate(f)]
    return [*moved, *spots, *middles], quads


def collected(vertices, faces, package="p0"):
    v = {r.vertex: [r.x, r.y, r.z] for r in vertices.filter(f"package_id = '{package}'").collect()}
    f = {r.face: tuple(r.corners) for r in faces.filter(f"package_id = '{package}'").collect()}
    return [v[k] for k in range(len(v))], [f[k] for k in range(len(f))]


def check(spark, points, faces):
    got = collected(*subdivision.subdivide(*mesh(spark, points, faces, 2), KEYS), "p1")
    want = plain(points, faces)
    assert np.allclose(got[0], want[0]) and got[1] == want[1]
    return got


def test_a_cube_has_26_vertices_and_24_quads(spark):
    points, quads = check(spark, CUBE, SIDES)
    assert len(points) == 26 and len(quads) == 24
    assert np.allclose(points[0], [2 / 9] * 3) and np.allclose(np.mean(points, axis=0), [0.5] * 3)


def test_open_and_odd_meshes(spark):
    check(spark, [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (2, 0, 1), (2, 1, 1), (9, 9, 9)], [(0, 1, 2, 3), (1, 4, 5, 2)])
    check(spark, [(0, 0, 0), (2, 0, 0), (1, 2, 0), (1, 1, 2), (1, 1, -2)], [(0, 1, 2), (0, 2, 3), (0, 1, 4), (0, 1, 3)])


def test_two_steps(spark):
    vertices, faces = subdivision.refine(*mesh(spark, CUBE, SIDES), KEYS, 2)
    points, quads = plain(*plain(CUBE, SIDES))
    got = collected(vertices, faces)
    assert np.allclose(got[0], points) and got[1] == quads
    assert len(points) == 98 and len(quads) == 96


def test_limits(spark):
    _, faces = mesh(spark, CUBE, SIDES)
    assert subdivision.above_limit(faces, KEYS, 2, 95).first().reason == "DXF_MESH_FACE_LIMIT_EXCEEDED"
    assert subdivision.above_limit(faces, KEYS, 2, 96).count() == 0 and subdivision.above_limit(faces, KEYS, 0, 1).count() == 0


def test_meshes_of_a_drawing(spark):
    e = drawing(spark, "0 MESH 5 A 91 2 92 4 10 0 20 0 30 0 10 1 20 0 30 0 10 1 20 1 30 0 10 0 20 1 30 5 93 12 90 4 90 0 90 1 90 2 90 3 90 2 90 0 90 1 90 3 90 0 90 1 90 9 94 1 90 0 90 1 95 1 140 0.5", "0 MESH 5 B 92 0 93 0")
    vertices, faces = dxf_geometry.subdivision_meshes(e)
    assert sorted((r.vertex, r.x, r.y, r.z) for r in vertices.collect()) == [(0, 0, 0, 0), (1, 1, 0, 0), (2, 1, 1, 0), (3, 0, 1, 5)]
    assert [(r.face, r.corners, r.level) for r in faces.collect()] == [(0, [0, 1, 2, 3], 2)]


def test_multilines_of_a_drawing(spark):
    e = drawing(spark, "0 MLINE 5 A 2 STD 71 2 72 2 73 2 11 0 21 0 31 1 13 0 23 1 33 0 74 2 41 0.5 41 9 74 0 11 4 21 0 31 1 13 0 23 2 33 0 74 1 41 0.5 74 1 41 -1", "0 MLINE 5 B 72 0 73 0")
    got = {r.element: r for r in dxf_geometry.multilines(e).collect()}
    assert set(got) == {0, 1} and got[0].closed and got[0].style == "STD"
    assert got[0].points == [[0, 0.5, 1], [4, 1, 1]] and got[1].points == [[0, 0, 1], [4, -2, 1]]


def test_meshes_are_never_sent_through_the_driver(spark):
    """Meshes of much alike numbers are small as files; their joins merge all the same."""
    vertices = spark.range(8).select((F.col("id") / 100).cast("int").alias("k"), F.col("id").cast("int").alias("vertex"), *[F.col("id").cast("double").alias(c) for c in "xyz"])
    faces = spark.range(2).select((F.col("id") / 100).cast("int").alias("k"), F.col("id").cast("int").alias("face"), F.array(*map(F.lit, (0, 1, 2, 3))).alias("corners"))
    for rows in subdivision.subdivide(vertices, faces, ["k"]):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
