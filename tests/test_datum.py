import math

import pytest

from trussline.operators import datum

OPS = "operation_id string, source_ellipsoid string, target_ellipsoid string, dx double, dy double, dz double, required_grids array<string>, maximum_points int, horizontal_tolerance double, vertical_tolerance double"
POINTS = "solution_id string, place int, operation_id string, lat double, lon double, h double"


@pytest.fixture
def operations(spark):
    rows = [("shift", "GRS80", "WGS84", 1.0, 1.0, -1.0, [], 100, 1e-9, 1e-6), ("far", "INTL", "WGS84", -87.0, -98.0, -121.0, [], 2, 1e-9, 1e-6), ("grid", "GRS80", "WGS84", 0.0, 0.0, 0.0, ["x.tif"], 9, 1e-9, 1e-6), ("strict", "GRS80", "WGS84", 1.0, 1.0, 1.0, [], 9, -1.0, 1e-6), ("odd", "MOON", "WGS84", 0.0, 0.0, 0.0, [], 9, 1e-9, 1e-6)]
    return spark.createDataFrame(rows, OPS)


def geocentric(lat, lon, h, a, f):
    e = (2 - 1 / f) / f
    lat, lon = math.radians(lat), math.radians(lon)
    n = a / math.sqrt(1 - e * math.sin(lat) ** 2)
    return (n + h) * math.cos(lat) * math.cos(lon), (n + h) * math.cos(lat) * math.sin(lon), (n * (1 - e) + h) * math.sin(lat)


def test_points_move_by_the_shift_and_come_back(spark, operations):
    spots = [(lat, lon, h) for lat in (-89.9, -45.0, 0.0, 1e-7, 33.3, 89.9) for lon in (-180.0, -75.0, 0.0, 179.999) for h in (-500.0, 0.0, 90_000.0)]
    points = spark.createDataFrame([("s", k, op, *p) for op in ("shift", "far") for k, p in enumerate(spots)], POINTS)
    shift = {r.operation_id: r for r in operations.collect()}
    for r in datum.shifted_points(points, operations).collect():
        o = shift[r.operation_id]
        before = geocentric(r.lat, r.lon, r.h, *datum.ELLIPSOIDS[o.source_ellipsoid])
        after = geocentric(r.new_lat, r.new_lon, r.new_h, *datum.ELLIPSOIDS["WGS84"])
        assert r.error is None and r.horizontal < 1e-9 and r.vertical < 1e-6
        assert all(abs(a + d - b) < 1e-5 for a, b, d in zip(before, after, (o.dx, o.dy, o.dz)))


def test_faults(spark, operations):
    rows = [("a", 0, "none", 1.0, 1.0, 1.0), ("b", 0, "grid", 1.0, 1.0, 1.0), ("c", 0, "shift", 90.1, 0.0, 0.0), ("c", 1, "shift", 1.0, 0.0, 0.0), ("d", 0, "shift", float("nan"), 0.0, 0.0), ("e", 0, "shift", 1.0, None, 0.0), ("f", 0, "strict", 1.0, 1.0, 0.0), ("g", 0, "odd", 1.0, 1.0, 0.0)]
    rows += [("h", k, "far", 1.0, 1.0, 1.0) for k in range(3)] + [("i", 0, "far", 1.0, 1.0, 100_001.0), ("j", 0, "shift", 5.0, 5.0, 5.0)]
    got = {r.solution_id: (r.error, r.points) for r in datum.coordinate_solutions(datum.shifted_points(spark.createDataFrame(rows, POINTS), operations)).collect()}
    invalid = "CRS_POINT_INVALID"
    assert got == {"a": ("CRS_OPERATION_UNKNOWN", 1), "b": ("CRS_GRID_OPERATION_UNSUPPORTED", 1), "c": (invalid, 2), "d": (invalid, 1), "e": (invalid, 1), "f": ("CRS_ROUND_TRIP_TOLERANCE_EXCEEDED", 1), "g": ("CRS_OPERATION_METADATA_MISMATCH", 1), "h": ("CRS_POINT_LIMIT_EXCEEDED", 3), "i": (invalid, 1), "j": (None, 1)}


def test_registries(spark):
    rows = spark.createDataFrame([("r", "A", '{"x":1,"y":2}'), ("r", "A", '{"y":2,"x":1}'), ("r", "B", "{}"), ("r", "C", '{"x":1}'), ("r", "C", '{"x":2}'), ("s", "A", "{}")], "registry_id string, identifier string, json string")
    assert {(r.registry_id, r.code, r.identifier) for r in datum.registry_faults(rows).collect()} == {("r", "CRS_RECORD_DUPLICATE", "A"), ("r", "CRS_RECORD_CONFLICTING", "C")}


def test_plans_stay_small(spark, operations):
    points = spark.createDataFrame([("s", 0, "shift", 1.0, 2.0, 3.0)], POINTS)
    assert len(datum.shifted_points(points, operations)._jdf.queryExecution().optimizedPlan().toString()) < 30_000
