"""Datum operations on geographic points as column expressions, with their round trip, and the rules of their registry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trussline.functions.canon import canonical_json

# Semi-major axis in metres and inverse flattening of ellipsoids.
ELLIPSOIDS = {"GRS80": (6378137.0, 298.257222101), "WGS84": (6378137.0, 298.257223563), "INTL": (6378388.0, 297.0), "CLRK66": (6378206.4, 294.978698214)}
#: Steps of the way back to latitude; each gains more than two digits.
STEPS = 9
HIGHEST = 100_000.0


def _axes(name: Column) -> tuple[Column, Column]:
    """Semi-major axis and squared eccentricity of a named ellipsoid; null for other names."""
    table = {k: (a, (2 - 1 / f) / f) for k, (a, f) in ELLIPSOIDS.items()}
    one = lambda k: reduce(lambda other, item: F.when(name == item[0], F.lit(item[1][k])).otherwise(other), table.items(), F.lit(None).cast("double"))
    return one(0), one(1)


def _in_steps(rows: DataFrame, columns: list[dict[str, Column]]) -> DataFrame:
    """Columns in groups, each of which may use those before; so no expression is written out twice."""
    return reduce(lambda df, more: df.withColumns(more), columns, rows)


def _there(rows: DataFrame, lat: str, lon: str, high: str, source: str, target: str, sign: int, out: str) -> DataFrame:
    """``out_lat``, ``out_lon``, ``out_h``: a point shifted by ``sign`` times (dx, dy, dz) between two ellipsoids."""
    a, e = _axes(F.col(source))
    b, g = _axes(F.col(target))
    c = F.col
    steps = [
        {"__a": a, "__e": e, "__b": b, "__g": g, "__phi": F.radians(lat), "__lam": F.radians(lon)},
        {"__n": c("__a") / F.sqrt(1 - c("__e") * F.sin("__phi") * F.sin("__phi"))},
        {
            "__x": (c("__n") + c(high)) * F.cos("__phi") * F.cos("__lam") + sign * c("dx"),
            "__y": (c("__n") + c(high)) * F.cos("__phi") * F.sin("__lam") + sign * c("dy"),
            "__z": (c("__n") * (1 - c("__e")) + c(high)) * F.sin("__phi") + sign * c("dz"),
        },
        {"__p": F.sqrt(c("__x") * c("__x") + c("__y") * c("__y"))},
        {"__back": F.aggregate(F.array_repeat(F.lit(0.0), STEPS), F.atan2(c("__z"), c("__p") * (1 - c("__g"))), lambda phi, _: F.atan2(c("__z") + c("__g") * c("__b") / F.sqrt(1 - c("__g") * F.sin(phi) * F.sin(phi)) * F.sin(phi), c("__p")))},
        {
            f"{out}_lat": F.degrees("__back"),
            f"{out}_lon": F.degrees(F.atan2(c("__y"), c("__x"))),
            f"{out}_h": c("__p") * F.cos("__back") + c("__z") * F.sin("__back") - c("__b") * F.sqrt(1 - c("__g") * F.sin("__back") * F.sin("__back")),
        },
    ]
    return _in_steps(rows, steps).drop("__a", "__e", "__b", "__g", "__phi", "__lam", "__n", "__x", "__y", "__z", "__p", "__back")


def point_fault(lat: Column, lon: Column, high: Column) -> Column:
    """Whether a point is no finite latitude, longitude and height within their domain."""
    within = lambda v, most: F.coalesce((F.abs(v) <= most) & ~F.isnan(v), F.lit(False))
    return ~(within(lat, 90.0) & within(lon, 180.0) & within(high, HIGHEST))


def shifted_points(points: DataFrame, operations: DataFrame) -> DataFrame:
    """Points (solution_id, place, operation_id, lat, lon, h) under the operations that they name.

    ``operations`` has (operation_id, source_ellipsoid, target_ellipsoid, dx, dy, dz, required_grids, maximum_points,
    horizontal_tolerance, vertical_tolerance), one row each. Adds new_lat, new_lon, new_h, the residuals of the way back, and ``error``.
    """
    told = points.join(operations, "operation_id", "left")
    bad = point_fault(F.col("lat"), F.col("lon"), F.col("h"))
    there = _there(told, "lat", "lon", "h", "source_ellipsoid", "target_ellipsoid", 1, "new")
    back = _there(there, "new_lat", "new_lon", "new_h", "target_ellipsoid", "source_ellipsoid", -1, "back")
    turn = F.abs(F.col("back_lon") - F.col("lon"))
    moved = back.withColumns({"horizontal": F.greatest(F.abs(F.col("back_lat") - F.col("lat")), F.least(turn, 360 - turn)), "vertical": F.abs(F.col("back_h") - F.col("h"))})
    error = (
        F.when(F.col("maximum_points").isNull(), "CRS_OPERATION_UNKNOWN")
        .when(F.size("required_grids") > 0, "CRS_GRID_OPERATION_UNSUPPORTED")
        .when(bad, "CRS_POINT_INVALID")
        .when(F.col("new_lat").isNull(), "CRS_OPERATION_METADATA_MISMATCH")
        .when((F.col("horizontal") > F.col("horizontal_tolerance")) | (F.col("vertical") > F.col("vertical_tolerance")), "CRS_ROUND_TRIP_TOLERANCE_EXCEEDED")
    )
    return moved.withColumn("error", error).drop("back_lat", "back_lon", "back_h")


def coordinate_solutions(shifted: DataFrame) -> DataFrame:
    """(solution_id, operation_id, points, max_horizontal, max_vertical, error): one row a solution; any fault of a point, or too many points, is the solution's."""
    n = F.count("*")
    grouped = shifted.groupBy("solution_id", "operation_id").agg(n.alias("points"), F.max("horizontal").alias("max_horizontal"), F.max("vertical").alias("max_vertical"), F.min("error").alias("error"), F.first("maximum_points").alias("most"))
    error = F.when(F.col("points") > F.col("most"), "CRS_POINT_LIMIT_EXCEEDED").otherwise(F.col("error"))
    sound = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    return grouped.withColumn("error", error).select("solution_id", "operation_id", "points", sound("max_horizontal"), sound("max_vertical"), "error")


def registry_faults(entries: DataFrame) -> DataFrame:
    """(registry_id, code, identifier) for entries (registry_id, identifier, json): an identifier that comes twice, alike or not."""
    counts = entries.groupBy("registry_id", "identifier").agg(F.count("*").alias("n"), F.count_distinct(canonical_json("json")).alias("forms"))
    code = F.when(F.col("forms") > 1, "CRS_RECORD_CONFLICTING").otherwise("CRS_RECORD_DUPLICATE")
    return counts.filter("n > 1").select("registry_id", code.alias("code"), "identifier")
