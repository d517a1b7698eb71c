"""Geometry of drawing entities: parameters of curves, extrusion axes, and polylines that are meshes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["package_id", "path", "nth"]
#: Bits of a polyline's flags (code 70) and of its vertices' flags.
POLYLINE_3D, POLYGON_MESH, POLYFACE_MESH = 8, 16, 64
VERTEX_FACE, VERTEX_PLACE = 128, 64


def _value(code: int, k: int | Column = 0) -> Column:
    return F.get(F.try_element_at("series", F.lit(code)), k)


def _last(code: int) -> Column:
    return F.try_element_at(F.try_element_at("series", F.lit(code)), F.lit(-1))


def _point(code: int, k: int | Column = 0) -> Column:
    """[x, y, z] of the k-th point of a coordinate code; points of two values lie at z = 0, and null is no point."""
    x, y, z = (_value(code + step, k) for step in (0, 10, 20))
    return F.when(x.isNotNull() & y.isNotNull(), F.array(x, y, F.coalesce(z, F.lit(0.0))))


def _points(code: int, count: Column) -> Column:
    none = F.array().cast("array<array<double>>")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda k: _point(code, k))).otherwise(none)


def _cross(a: Column, b: Column) -> Column:
    return F.array(*[a[i] * b[j] - a[j] * b[i] for i, j in ((1, 2), (2, 0), (0, 1))])


def _length(a: Column) -> Column:
    return F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2])


def _with_extrusion(rows: DataFrame) -> DataFrame:
    """``extrusion``: the unit normal of an entity's plane; z where the entity names none. Each step is a column, so that no expression is written out twice."""
    z = F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))
    steps = rows.withColumn("__normal", _point(210)).withColumn("__length", _length(F.col("__normal")))
    unit = F.transform("__normal", lambda v: v / F.col("__length"))
    return steps.withColumn("extrusion", F.when(F.col("__length") > 0, unit).otherwise(z)).drop("__normal", "__length")


def _with_world(rows: DataFrame, point: str, name: str) -> DataFrame:
    """``name``: the column ``point`` of the plane of ``extrusion`` in world coordinates, by the arbitrary-axis rule.

    Where the normal is near z (within 1/64), the plane's x axis is square to world y, else to world z.
    """
    n, zero = F.col("extrusion"), F.lit(0.0)
    near = (F.abs(n[0]) < 1 / 64) & (F.abs(n[1]) < 1 / 64)
    steps = rows.withColumn("__across", F.when(near, F.array(n[2], zero, -n[0])).otherwise(F.array(-n[1], n[0], zero)))
    steps = steps.withColumn("__wide", _length(F.col("__across")))
    steps = steps.withColumn("__x", F.transform("__across", lambda v: v / F.col("__wide")))
    steps = steps.withColumn("__y", _cross(n, F.col("__x")))
    p = F.col(point)
    world = F.array(*[p[0] * F.col("__x")[k] + p[1] * F.col("__y")[k] + p[2] * n[k] for k in range(3)])
    return steps.withColumn(name, F.when(p.isNotNull(), world)).drop("__across", "__wide", "__x", "__y")


def plane_entities(entities: DataFrame) -> DataFrame:
    """(package_id, path, nth, type, handle, kind, layer, extrusion, center, center_world, elevation) of circles, arcs, flat polylines, solids and traces."""
    rows = entities.filter(F.col("type").isin("CIRCLE", "ARC", "LWPOLYLINE", "SOLID", "TRACE"))
    center = F.when(F.col("type").isin("CIRCLE", "ARC"), _point(10))
    named = _with_extrusion(rows).select(*KEYS, "type", "handle", "kind", "layer", "extrusion", center.alias("center"), F.when(F.col("type") == "LWPOLYLINE", _value(38)).alias("elevation"))
    return _with_world(named, "center", "center_world")


def curves(entities: DataFrame) -> DataFrame:
    """Parameters of ellipses, splines, helices, rays and construction lines, one row each; what a type hasn't is null.

    A helix carries the values of its spline first, with their counts, and its own behind them.
    """
    t = F.col("type")
    spline, helix, line, ellipse = t.isin("SPLINE", "HELIX"), t == "HELIX", t.isin("RAY", "XLINE"), t == "ELLIPSE"
    n_knots, n_control, n_fit = (F.coalesce(_value(code), F.lit(0.0)).cast("int") for code in (72, 73, 74))
    some = lambda code: F.coalesce(F.try_element_at("series", F.lit(code)), F.array().cast("array<double>"))
    n_weights = F.size(some(41)) - F.when(helix, 1).otherwise(0)
    fields = {
        "center": F.when(ellipse, _point(10)),
        "major_axis": F.when(ellipse, _point(11)),
        "ratio": F.when(ellipse, _value(40)),
        "start_param": F.when(ellipse, _value(41)),
        "end_param": F.when(ellipse, _value(42)),
        "extrusion": F.when(ellipse, F.col("extrusion")),
        "degree": F.when(spline, _value(71).cast("int")),
        "flags": F.when(spline, _value(70).cast("int")),
        "knots": F.when(spline, F.slice(some(40), F.lit(1), n_knots)),
        "weights": F.when(spline, F.slice(some(41), F.lit(1), F.greatest(n_weights, F.lit(0)))),
        "control_points": F.when(spline, _points(10, n_control)),
        "fit_points": F.when(spline, _points(11, n_fit)),
        "start": F.when(line, _point(10)).when(helix, _point(11, n_fit)),
        "unit_vector": F.when(line, _point(11)),
        "axis_base_point": F.when(helix, _point(10, n_control)),
        "axis_vector": F.when(helix, _point(12)),
        "radius": F.when(helix, _last(40)),
        "turns": F.when(helix, _last(41)),
        "turn_height": F.when(helix, _last(42)),
        "handedness": F.when(helix, _last(290).cast("int")),
    }
    return _with_extrusion(entities.filter(spline | line | ellipse)).select(*KEYS, "type", "handle", *[value.alias(name) for name, value in fields.items()])


def _polyline_parts(entities: DataFrame) -> DataFrame:
    """Vertices with the number, flags and mesh sizes of the polyline before them."""
    w = Window.partitionBy("package_id", "path").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    is_line = F.col("type") == "POLYLINE"
    head = F.struct(F.col("nth").alias("polyline"), *[F.coalesce(_value(code), F.lit(0.0)).cast("int").alias(name) for code, name in ((70, "mode"), (71, "m"), (72, "n"))])
    owned = entities.filter(F.col("type").isin("POLYLINE", "VERTEX", "SEQEND")).withColumn("head", F.last(F.when(is_line, head), ignorenulls=True).over(w))
    return owned.filter("type = 'VERTEX' and head is not null").select("package_id", "path", "nth", "series", "head.*", F.coalesce(_value(70), F.lit(0.0)).cast("int").alias("flags"))


def polyline_meshes(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (package_id, path, polyline, vertex, x, y, z) and faces (.., face, corners) of polylines in space.

    Polygon meshes have the quads of their grid. In polyface meshes equal places are one vertex, numbered as the faces
    first name them; faces of fewer than three corners are left out. Lines in space have vertices only.
    """
    parts = _polyline_parts(entities)
    key = ["package_id", "path", "polyline"]
    bit = lambda column, mask: F.col(column).bitwiseAND(mask) != 0
    order = Window.partitionBy(*key).orderBy("nth")
    place = _point(10)
    is_grid, is_polyface = bit("mode", POLYGON_MESH), bit("mode", POLYFACE_MESH)

    numbered = parts.filter((bit("mode", POLYLINE_3D) | is_grid) & place.isNotNull()).withColumns({"p": place, "vertex": F.row_number().over(order) - 1})
    grids = parts.filter(is_grid).select(*key, "m", "n").distinct().filter("m > 1 and n > 1")
    cells = grids.withColumn("face", F.explode(F.sequence(F.lit(0), (F.col("m") - 1) * (F.col("n") - 1) - 1)))
    low = F.floor(F.col("face") / (F.col("n") - 1)).cast("int") * F.col("n") + F.col("face") % (F.col("n") - 1)
    quads = cells.select(*key, "face", F.array(low, low + F.col("n"), low + F.col("n") + 1, low + 1).alias("corners"))

    is_place = bit("flags", VERTEX_PLACE)
    shaped = parts.filter(is_polyface)
    places = shaped.filter(is_place & place.isNotNull()).select(*key, F.row_number().over(order).alias("index"), place.alias("p"))
    named = shaped.filter(bit("flags", VERTEX_FACE) & ~is_place).select(*key, (F.row_number().over(order) - 1).alias("face"), F.filter(F.array(*[F.abs(_value(code)).cast("int") for code in (71, 72, 73, 74)]), lambda i: i > 0).alias("i"))
    corners = named.select(*key, "face", F.posexplode("i").alias("corner", "index")).join(places, [*key, "index"])
    first = F.min(F.struct("face", "corner")).over(Window.partitionBy(*key, "p"))
    corners = corners.withColumn("first", first).withColumn("vertex", F.dense_rank().over(Window.partitionBy(*key).orderBy("first")) - 1)
    faces = corners.groupBy(*key, "face").agg(F.array_sort(F.collect_list(F.struct("corner", "vertex")))["vertex"].alias("corners")).filter(F.size("corners") >= 3)
    vertices = numbered.select(*key, "vertex", "p").union(corners.select(*key, "vertex", "p").distinct())
    return vertices.select(*key, "vertex", *[F.col("p")[k].alias(c) for k, c in enumerate("xyz")]), quads.union(faces)


def _some(code: int) -> Column:
    return F.coalesce(F.try_element_at("series", F.lit(code)), F.array().cast("array<double>"))


def subdivision_meshes(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (package_id, path, nth, vertex, x, y, z) and faces (.., face, corners, level) of MESH entities.

    Code 90 holds the faces, each as its number of corners and their vertices, in as many values as code 93 says; edges and creases lie behind them. Faces of
    fewer than three corners, or with a corner that is no vertex, are left out.
    """
    meshes = entities.filter("type = 'MESH'")
    count = F.coalesce(_value(92), F.lit(0.0))
    points = meshes.select(*KEYS, F.posexplode(_points(10, count)).alias("vertex", "p"))
    vertices = points.filter("p is not null").select(*KEYS, "vertex", *[F.col("p")[k].alias(c) for k, c in enumerate("xyz")])
    listed = F.transform(F.slice(_some(90), F.lit(1), F.coalesce(_value(93), F.lit(0.0)).cast("int")), lambda v: v.cast("int"))
    empty = F.struct(F.lit(0).alias("left"), F.array().cast("array<int>").alias("now"), F.array().cast("array<array<int>>").alias("faces"))

    def step(held: Column, v: Column) -> Column:
        now = F.concat(held["now"], F.array(v))
        begins, ends = held["left"] == 0, held["left"] == 1
        return F.struct(
            F.when(begins, v).otherwise(held["left"] - 1).alias("left"),
            F.when(begins | ends, F.array().cast("array<int>")).otherwise(now).alias("now"),
            F.when(ends, F.concat(held["faces"], F.array(now))).otherwise(held["faces"]).alias("faces"),
        )

    level = F.coalesce(_value(91), F.lit(0.0)).cast("int")
    faces = meshes.select(*KEYS, level.alias("level"), count.alias("n"), F.posexplode(F.aggregate(listed, empty, step)["faces"]).alias("face", "corners"))
    whole = F.forall("corners", lambda v: (v >= 0) & (v < F.col("n")))
    return vertices, faces.filter((F.size("corners") >= 3) & whole).select(*KEYS, "face", "corners", "level")


def multilines(entities: DataFrame) -> DataFrame:
    """(package_id, path, nth, handle, style, element, closed, points) of MLINE entities: the line of each element, mitred.

    At each vertex, code 74 tells how many values of code 41 belong to an element; the first is its distance along the mitre.
    """
    rows = entities.filter("type = 'MLINE'")
    n, elements = (F.coalesce(_value(code), F.lit(0.0)).cast("int") for code in (72, 73))
    begins = F.aggregate(_some(74), F.array(F.lit(0)), lambda ends, v: F.concat(ends, F.array(F.element_at(ends, -1) + v.cast("int"))))
    read = rows.select(*KEYS, "handle", F.col("block").alias("style"), (F.coalesce(_value(71), F.lit(0.0)).cast("int").bitwiseAND(2) != 0).alias("closed"), n.alias("n"), elements.alias("elements"), _points(11, n).alias("places"), _points(13, n).alias("mitres"), _some(41).alias("distances"), _some(74).alias("counts"), begins.alias("begins"))
    each = read.filter("n > 0 and elements > 0").withColumn("element", F.explode(F.sequence(F.lit(0), F.col("elements") - 1)))

    def at(place: Column, k: Column) -> Column:
        slot = k * F.col("elements") + F.col("element")
        away = F.when(F.get("counts", slot) > 0, F.get("distances", F.get("begins", slot))).otherwise(0.0)
        return F.zip_with(place, F.get("mitres", k), lambda p, m: p + m * F.coalesce(away, F.lit(0.0)))

    return each.select(*KEYS, "handle", "style", "element", "closed", F.transform("places", at).alias("points"))
