import base64
import json
import math
import struct

import pytest

from tests.test_scanners import files
from trussline.sources import binary_meshes, curve_samples, dxf_geometry, scanners


def drawing(spark, *entities):
    text = "0 SECTION 2 ENTITIES " + " ".join(entities) + " 0 ENDSEC 0 EOF"
    return scanners.dxf_entities(scanners.dxf_tags(files(spark, a="\n".join(text.split()))))


def test_curves(spark):
    e = drawing(
        spark,
        "0 ELLIPSE 5 A 10 1 20 2 30 3 11 2 21 0 31 0 40 0.5 41 0 42 6.283185307179586",
        "0 SPLINE 5 B 70 8 71 1 72 4 73 2 74 0 40 0 40 0 40 1 40 1 10 0 20 0 30 0 10 5 20 6 30 7",
        "0 HELIX 5 C 71 1 72 2 73 1 74 0 40 0 40 1 10 9 20 9 30 9 10 1 20 1 30 1 11 2 21 1 31 1 12 0 22 0 32 1 40 3 41 4 42 0.25 290 1",
        "0 RAY 5 D 10 1 20 1 11 0 21 1",
        "0 LINE 5 E 10 0 20 0",
    )
    got = {r.handle: r for r in dxf_geometry.curves(e).collect()}
    assert set(got) == set("ABCD")
    assert (got["A"].center, got["A"].major_axis, got["A"].ratio, got["A"].extrusion) == ([1, 2, 3], [2, 0, 0], 0.5, [0, 0, 1])
    assert (got["B"].degree, got["B"].knots, got["B"].control_points, got["B"].fit_points, got["B"].weights) == (1, [0, 0, 1, 1], [[0, 0, 0], [5, 6, 7]], [], [])
    c = got["C"]
    assert (c.axis_base_point, c.start, c.axis_vector, c.radius, c.turns, c.turn_height, c.handedness, c.weights) == ([1, 1, 1], [2, 1, 1], [0, 0, 1], 3, 4, 0.25, 1, [])
    assert (got["D"].start, got["D"].unit_vector, got["D"].center) == ([1, 1, 0], [0, 1, 0], None)


def test_ellipses_are_sampled_within_the_error(spark):
    e = drawing(spark, "0 ELLIPSE 5 A 10 0 20 0 30 0 11 2 21 0 31 0 40 0.5 41 0 42 6.283185307179586", "0 ELLIPSE 5 B 10 0 20 0 11 1e9 21 0 40 0.5 41 0 42 6", "0 ELLIPSE 5 C 10 0 20 0")
    got = {r.handle: r for r in curve_samples.sampled_curves(dxf_geometry.curves(e)).collect()}
    points = got["A"].points
    assert all(abs((x / 2) ** 2 + y**2 - 1) < 1e-12 and z == 0 for x, y, z in points)
    for (ax, ay, _), (bx, by, _) in zip(points, points[1:]):
        x, y = (ax + bx) / 2, (ay + by) / 2
        angle = math.atan2(y, x / 2)
        assert math.hypot(x - 2 * math.cos(angle), y - math.sin(angle)) <= 1e-3
    assert (got["B"].points, got["B"].reason) == (None, "DXF_CURVE_VERTEX_LIMIT_EXCEEDED")
    assert (got["C"].points, got["C"].reason) == (None, "DXF_CURVE_TESSELLATION_FAILED")


def test_planes(spark):
    e = drawing(spark, "0 CIRCLE 5 A 10 1 20 2 30 3 40 1", "0 CIRCLE 5 B 10 1 20 2 30 3 40 1 210 0 220 0 230 -1", "0 ARC 5 C 10 1 20 2 30 3 210 1 220 0 230 0", "0 LWPOLYLINE 5 D 38 4 10 0 20 0")
    got = {r.handle: r for r in dxf_geometry.plane_entities(e).collect()}
    assert got["A"].center_world == [1, 2, 3]
    assert got["B"].center_world == [-1, 2, -3]
    assert got["C"].center_world == [3, 1, 2]
    assert (got["D"].center_world, got["D"].elevation) == (None, 4)


def test_polyline_meshes(spark):
    at = lambda x, y, flags=64: f"0 VERTEX 10 {x} 20 {y} 30 0 70 {flags}"
    grid = " ".join(at(x, y) for x in range(2) for y in range(3))
    shape = " ".join([at(0, 0, 192), at(1, 0, 192), at(1, 1, 192), at(0, 0, 192), "0 VERTEX 10 0 20 0 70 128 71 2 72 -3 73 4", "0 VERTEX 10 0 20 0 70 128 71 1 72 2"])
    e = drawing(spark, f"0 POLYLINE 5 A 70 16 71 2 72 3 {grid} 0 SEQEND", f"0 POLYLINE 5 B 70 64 {shape} 0 SEQEND", f"0 POLYLINE 5 C 70 8 {at(7, 8, 32)} 0 SEQEND", f"0 POLYLINE 5 D 70 0 {at(1, 1, 0)} 0 SEQEND")
    names = {r.nth: r.handle for r in e.filter("type = 'POLYLINE'").collect()}
    vertices, faces = dxf_geometry.polyline_meshes(e)
    v, f = {}, {}
    for r in vertices.orderBy("vertex").collect():
        v.setdefault(names[r.polyline], []).append((r.x, r.y))
    for r in faces.orderBy("face").collect():
        f.setdefault(names[r.polyline], []).append(list(r.corners))
    assert v == {"A": [(x, y) for x in range(2) for y in range(3)], "B": [(1, 0), (1, 1), (0, 0)], "C": [(7, 8)]}
    assert f == {"A": [[0, 3, 4, 1], [1, 4, 5, 2]], "B": [[0, 1, 2]]}


def scene(binary=True, **changes):
    points = struct.pack("<12f", 0, 0, 0, 1, 0, 0, 0, 1, 0, 1, 1, 0)
    index = struct.pack("<6H", 0, 1, 2, 2, 1, 3)
    data = points + index
    buffer = {"byteLength": len(data)} | ({} if binary else {"uri": "data:application/octet-stream;base64," + base64.b64encode(data).decode()})
    doc = {
        "asset": {"version": "2.0"},
        "scenes": [{"nodes": [0]}],
        "nodes": [{"translation": [10, 0, 0], "children": [1]}, {"mesh": 0, "scale": [2, 2, 2]}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": 4, "type": "VEC3"}, {"bufferView": 1, "componentType": 5123, "count": 6, "type": "SCALAR"}],
        "bufferViews": [{"buffer": 0, "byteLength": 48}, {"buffer": 0, "byteOffset": 48, "byteLength": 12}],
        "buffers": [buffer],
    } | changes
    text = json.dumps(doc).encode()
    if not binary:
        return text
    text += b" " * (-len(text) % 4)
    body = struct.pack("<II", len(text), 0x4E4F534A) + text + struct.pack("<II", len(data), 0x004E4942) + data
    return b"glTF" + struct.pack("<II", 2, 12 + len(body)) + body


def test_binary_meshes(spark):
    stl = b"solid but bytes".ljust(80) + struct.pack("<I", 2) + b"".join(struct.pack("<12fH", 0, 0, 1, *range(k, k + 9), 0) for k in (0, 9))
    named = {"stl": stl, "glb": scene(), "gltf": scene(binary=False), "cut": scene()[:-20], "out": scene(binary=False, buffers=[{"uri": "a.bin"}]), "old": scene(binary=False, asset={"version": "1.0"}), "text": "solid x", "none": "", "odd": "{"}
    rows = binary_meshes.binary_triangles(files(spark, **named)).collect()
    points = {name: [(r.x, r.y, r.z) for r in sorted(rows, key=lambda r: r.vertex or 0) if r.path == name and r.error is None] for name in named}
    assert points["stl"] == [tuple(range(k, k + 3)) for k in range(0, 18, 3)]
    assert points["glb"] == points["gltf"] == [(10, 0, 0), (12, 0, 0), (10, 2, 0), (10, 2, 0), (12, 0, 0), (12, 2, 0)]
    assert {r.path: r.error for r in rows if r.error} == {"cut": "MESH_PARSE_FAILED", "out": "MESH_EXTERNAL_RESOURCE", "old": "MESH_VERSION_UNSUPPORTED", "text": "MESH_FORMAT_UNSUPPORTED", "none": "MESH_FORMAT_UNSUPPORTED", "odd": "MESH_PARSE_FAILED"}


@pytest.mark.parametrize("mode, want", [(5, [(0, 1, 2), (2, 1, 3)]), (6, [(0, 1, 2), (0, 2, 3)])])
def test_strips_and_fans(mode, want):
    points = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)]
    content = scene(scenes=[], meshes=[{"primitives": [{"attributes": {"POSITION": 0}, "mode": mode}]}])
    assert binary_meshes.gltf_corners(content).tolist() == [[list(map(float, points[i])) for i in t] for t in want]
