"""Subdivision surfaces: one Catmull-Clark step over any number of meshes, by joins on shared edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussline.storage import joined

AXES = ("x", "y", "z")
#: Faces of a refined mesh, at most.
FACES = 5_000_000


def _named(prefix: str, rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({c: prefix + c for c in AXES})


def _rank(keys: Sequence[str], *order: str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1


def subdivide(vertices: DataFrame, faces: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Vertices (keys, vertex, x, y, z) and faces (keys, face, corners) after one step.

    Vertices keep their numbers; behind them come the points of the edges in the order of their ends, then those of the
    faces. Every corner of a face becomes a quad. An edge of one face, or of more than two, is a crease: its point is its middle, a
    vertex of two creases stays on their curve, and one of more stays where it is. Vertices of no face stay.
    """
    keys = list(keys)
    sizes = vertices.groupBy(*keys).agg((F.max("vertex") + 1).alias("n_vertices"))
    n = F.size("corners")
    turns = F.transform("corners", lambda v, k: F.struct(k.alias("corner"), v.alias("vertex"), F.get("corners", (k + 1) % n).alias("after"), F.get("corners", (k + n - 1) % n).alias("before")))
    corners = faces.select(*keys, "face", F.explode(turns).alias("c")).select(*keys, "face", "c.*")
    placed = joined(corners, vertices, [*keys, "vertex"])
    face_points = placed.groupBy(*keys, "face").agg(*[F.avg(c).alias(f"f{c}") for c in AXES])
    at_faces = joined(corners, face_points, [*keys, "face"])

    ends = at_faces.withColumns({"low": F.least("vertex", "after"), "high": F.greatest("vertex", "after")})
    edges = ends.groupBy(*keys, "low", "high").agg(F.count("*").alias("n_faces"), *[F.sum(f"f{c}").alias(f"f{c}") for c in AXES])
    edges = joined(joined(edges, _named("a", vertices).withColumnRenamed("vertex", "low"), [*keys, "low"]), _named("b", vertices).withColumnRenamed("vertex", "high"), [*keys, "high"])
    edges = edges.withColumn("crease", F.col("n_faces") != 2).withColumn("edge", _rank(keys, "low", "high"))
    middle = {c: (F.col(f"a{c}") + F.col(f"b{c}")) / 2 for c in AXES}
    edges = edges.select(*keys, "low", "high", "edge", "crease", *[middle[c].alias(f"m{c}") for c in AXES], *[F.when(F.col("crease"), middle[c]).otherwise((F.col(f"a{c}") + F.col(f"b{c}") + F.col(f"f{c}")) / 4).alias(c) for c in AXES])

    by_faces = at_faces.groupBy(*keys, "vertex").agg(*[F.avg(f"f{c}").alias(f"q{c}") for c in AXES])
    both = edges.withColumn("vertex", F.explode(F.array("low", "high")))
    by_edges = both.groupBy(*keys, "vertex").agg(
        F.count("*").alias("valence"), F.count_if("crease").alias("creases"), *[F.avg(f"m{c}").alias(f"r{c}") for c in AXES], *[F.sum(F.when(F.col("crease"), F.col(f"m{c}"))).alias(f"k{c}") for c in AXES]
    )
    near = joined(joined(vertices, by_faces, [*keys, "vertex"], "left"), by_edges, [*keys, "vertex"], "left")
    moved = {
        c: F.when(F.col("creases") == 0, (F.col(f"q{c}") + 2 * F.col(f"r{c}") + (F.col("valence") - 3) * F.col(c)) / F.col("valence")).when(F.col("creases") == 2, F.col(f"k{c}") / 4 + F.col(c) / 2).otherwise(F.col(c))
        for c in AXES
    }
    number = lambda c: F.col(c).cast("int").alias("vertex")
    olds = near.select(*keys, number("vertex"), *[moved[c].alias(c) for c in AXES])
    edges = joined(edges, sizes, keys).withColumn("vertex", F.col("n_vertices") + F.col("edge"))
    counts = edges.groupBy(*keys).agg(F.count("*").alias("n_edges"))
    middles = joined(joined(face_points.withColumn("place", _rank(keys, "face")), sizes, keys), counts, keys).withColumn("vertex", F.col("n_vertices") + F.col("n_edges") + F.col("place"))
    points = olds.union(edges.select(*keys, number("vertex"), *AXES)).union(middles.select(*keys, number("vertex"), *[F.col(f"f{c}").alias(c) for c in AXES]))

    on = lambda name: edges.select(*keys, F.col("low").alias(f"low_{name}"), F.col("high").alias(f"high_{name}"), F.col("vertex").alias(name))
    quads = corners.withColumns({"low_next": F.least("vertex", "after"), "high_next": F.greatest("vertex", "after"), "low_last": F.least("vertex", "before"), "high_last": F.greatest("vertex", "before")})
    for name in ("next", "last"):
        quads = joined(quads, on(name), [*keys, f"low_{name}", f"high_{name}"])
    quads = joined(quads, middles.select(*keys, "face", F.col("vertex").alias("middle")), [*keys, "face"])
    shape = F.array(*[F.col(c).cast("int") for c in ("vertex", "next", "middle", "last")])
    return points, quads.select(*keys, _rank(keys, "face", "corner").alias("face"), shape.alias("corners"))


def refine(vertices: DataFrame, faces: DataFrame, keys: Sequence[str], levels: int) -> tuple[DataFrame, DataFrame]:
    """``levels`` steps for all meshes; the caller stores what it steps over often."""
    for _ in range(levels):
        vertices, faces = subdivide(vertices, faces, keys)
    return vertices, faces


def above_limit(faces: DataFrame, keys: Sequence[str], levels: int, most: int = FACES) -> DataFrame:
    """(keys, reason) of the meshes that ``levels`` steps would give more than ``most`` faces."""
    grown = faces.groupBy(*keys).agg(F.sum(F.size("corners").cast("long")).alias("n")).filter(F.col("n") * 4 ** max(levels - 1, 0) > most)
    return grown.filter(F.lit(levels > 0)).select(*keys, F.lit("DXF_MESH_FACE_LIMIT_EXCEEDED").alias("reason"))
