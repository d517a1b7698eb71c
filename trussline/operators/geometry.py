"""Meshes and coordinates: bounds, registration by control points, previews."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.functions.values import projected


def bounds(points: DataFrame, keys: list[str]) -> DataFrame:
    """Least and greatest x, y and z of the points of each key."""
    return points.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))])


def residuals(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Greatest and root mean square distance of points (x, y, z) from their targets (tx, ty, tz)."""
    d2 = (F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2 + (F.col("z") - F.col("tz")) ** 2
    return pairs.withColumn("__d2", d2).groupBy(*keys).agg(F.sqrt(F.max("__d2")).alias("max_residual"), F.sqrt(F.avg("__d2")).alias("rms_residual"))


def similarity(pairs: DataFrame, key: str, tolerance: float = 1e-6) -> DataFrame:
    """Scale, rotation and offset that best take control points (x, y, z) to (tx, ty, tz), for each key.

    (key, status, scale, matrix, max_misfit): status known, insufficient, collinear, reflection or tolerance_exceeded;
    the misfit is the largest distance of a moved point from its target. Points and targets are taken from their means
    first, so map coordinates lose no digits. Means, moments and misfits are aggregates in Spark over any number of
    points; only the 3x3 problem of each key goes to numpy. Points with a null coordinate don't count.
    """
    axes, targets = ("x", "y", "z"), ("tx", "ty", "tz")
    points = pairs.select(key, *axes, *targets).dropna(subset=[*axes, *targets])
    means = points.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in axes + targets])
    centred = points.join(means, points[key].eqNullSafe(means["__k"])).select(key, "n", *[f"m_{c}" for c in axes + targets], *[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in axes + targets])
    products = [(a, b) for k, a in enumerate(axes + targets) for b in (axes + targets)[k:]]
    moments = centred.groupBy(key).agg(F.first("n").alias("n"), *[F.avg(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in products])
    kind = pairs.schema[key].dataType.simpleString()

    def solve(row: dict) -> dict:
        second = np.array([[row[f"{a}_{b}"] if (a, b) in products else row[f"{b}_{a}"] for b in axes + targets] for a in axes + targets], np.float64)
        own, theirs, cross = second[:3, :3], second[3:, 3:], second[:3, 3:]
        size = max(np.trace(own), np.trace(theirs), 1e-300)
        if row["n"] < 3:
            return {"found": "insufficient"}
        if any(np.sort(np.linalg.eigvalsh(m))[1] <= 1e-12 * size for m in (own, theirs)):
            return {"found": "collinear"}
        # the turn that maximises trace(turn @ cross), kept free of reflections by the sign of the last direction
        left, stretch, right = np.linalg.svd(cross)
        sign = np.array([1.0, 1.0, np.sign(np.linalg.det(right.T @ left.T))])
        if sign[2] < 0 and stretch[2] > 1e-9 * stretch[0]:
            return {"found": "reflection"}
        turn = right.T @ np.diag(sign) @ left.T
        scale = float(stretch @ sign / np.trace(own))
        return {"found": "known", "scale": scale, "turn": (scale * turn).ravel().tolist(), "size": float(size)}

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([{"__k": r[key], "scale": None, "turn": None, "size": None} | solve(r) for r in frame.to_dict("records")], columns=["__k", "found", "scale", "turn", "size"])

    solved = moments.mapInPandas(run, f"__k {kind}, found string, scale double, turn array<double>, size double")
    moved = centred.join(solved, F.col(key).eqNullSafe(F.col("__k")))
    cell = lambda i, j: F.col("turn")[3 * i + j]
    apply = lambda i, of: sum((cell(i, j) * F.col(of(a)) for j, a in enumerate(axes)), F.lit(0.0))
    d2 = sum(((apply(i, str) - F.col(t)) ** 2 for i, t in enumerate(targets)), F.lit(0.0))
    every = moved.groupBy(key).agg(*[F.first(c).alias(c) for c in ("found", "scale", "turn", "size", *[f"m_{c}" for c in axes + targets])], F.sqrt(F.max(d2)).alias("max_misfit"))
    zero = F.lit(0.0)
    rows = [x for i, t in enumerate(targets) for x in (*[cell(i, j) for j in range(3)], F.col(f"m_{t}") - apply(i, "m_{}".format))]
    matrix = F.when(F.col("turn").isNotNull(), F.array(*rows, zero, zero, zero, F.lit(1.0)))
    close = F.col("max_misfit") <= F.greatest(F.lit(tolerance), 1e-9 * F.sqrt("size"))
    status = F.when((F.col("found") == "known") & ~close, "tolerance_exceeded").otherwise(F.col("found"))
    return every.select(key, status.alias("status"), "scale", matrix.alias("matrix"), F.when(F.col("turn").isNotNull(), F.col("max_misfit")).alias("max_misfit"))


def preview_polygons(faces: DataFrame, view: str) -> DataFrame:
    """(mesh_id, place, points) with each face's corners (x, y, z in an array column ``corners``) in a view, in drawing order."""
    from pyspark.sql import Window

    flat = F.transform("corners", lambda p: projected(F.lit(view), p[0], p[1], p[2]))
    text = F.array_join(F.transform(flat, lambda p: F.format_string("%.6f,%.6f", p[0], p[1])), " ")
    place = F.row_number().over(Window.partitionBy("mesh_id").orderBy("points"))
    return faces.select("mesh_id", text.alias("points")).withColumn("place", place)
