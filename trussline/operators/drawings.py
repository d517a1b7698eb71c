"""Drawings and models: nested inserts, references between files, paths, arcs, previews, attribute values, requirements."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussline.functions.values import matrix_product
from trussline.model import SUPPORT_LEVELS
from trussline.storage import stored


def walk(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(root, node, depth, matrix, status) of every use below the roots over edges (parent, child, matrix).

    A node used twice has two rows, each with the product of the matrices on its way. A step back to a node of its own way
    is a row with status ``cycle``, one below ``max_depth`` a row with status ``too_deep``; neither is followed.
    """
    unit = F.array(*[F.lit(1.0 if k % 5 == 0 else 0.0) for k in range(16)])
    front = stored(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), unit.alias("matrix"), F.array("root").alias("way"), F.lit("ok").alias("status")), "walk")
    done = [front.drop("way")]
    while True:
        step = front.filter("status = 'ok'").join(edges.select(F.col("parent").alias("node"), "child", F.col("matrix").alias("own")), "node")
        status = F.when(F.array_contains("way", F.col("child")), "cycle").when(F.col("depth") + 1 > max_depth, "too_deep").otherwise("ok")
        nxt = step.select("root", F.col("child").alias("node"), (F.col("depth") + 1).alias("depth"), matrix_product(F.col("matrix"), F.col("own")).alias("matrix"), F.concat("way", F.array("child")).alias("way"), status.alias("status"))
        front = stored(nxt, "walk")
        if front.isEmpty():
            return reduce(DataFrame.unionByName, done)
        done.append(front.drop("way"))


def unreached(entries: DataFrame, walked: DataFrame) -> DataFrame:
    """Entries (node) that no way leads to."""
    return entries.join(walked.select("node").distinct(), "node", "left_anti")


def insert_matrix(x: Column, y: Column, z: Column, scale: Column, degrees: Column) -> Column:
    """Matrix of an insert: one scale, a turn about the vertical, an offset."""
    c, s, zero = F.cos(F.radians(degrees)) * scale, F.sin(F.radians(degrees)) * scale, F.lit(0.0)
    return F.array(c, -s, zero, x, s, c, zero, y, zero, zero, scale, z, zero, zero, zero, F.lit(1.0))


def group_paths(operations: DataFrame, keys: list[str], paints: tuple[str, ...] = ("f", "F", "f*", "B", "B*", "b", "b*", "s", "S", "n")) -> DataFrame:
    """``operations`` (keys, seq, op) with the number of their path: a paint operation ends one. Null behind the last paint."""
    w = Window.partitionBy(*keys).orderBy("seq")
    paint = F.col("op").isin(*paints).cast("long")
    before = F.coalesce(F.sum(paint).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(paint).over(Window.partitionBy(*keys))
    numbered = operations.withColumns({"path": before, "__total": total})
    return numbered.withColumn("path", F.when(F.col("path") < F.col("__total"), F.col("path"))).drop("__total")


def polyline_points(tags: DataFrame) -> DataFrame:
    """(package_id, path, place, x, y) of the vertices in drawing tags: each code 10 and the code 20 behind it."""
    w = Window.partitionBy("package_id", "path").orderBy("place")
    nxt = tags.withColumns({"next_code": F.lead("code").over(w), "next_value": F.lead("value").over(w)})
    return nxt.filter("code = 10 and next_code = 20").select("package_id", "path", "place", F.col("value").try_cast("double").alias("x"), F.col("next_value").try_cast("double").alias("y"))


def arc_points(cx: Column, cy: Column, radius: Column, start: Column, end: Column, parts: int) -> Column:
    """Points [x, y] on an arc from ``start`` to ``end`` (radians), both included."""
    return F.transform(F.sequence(F.lit(0), F.lit(parts)), lambda k: F.array(cx + radius * F.cos(start + (end - start) * k / parts), cy + radius * F.sin(start + (end - start) * k / parts)))


def circle_through(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """struct(x, y, radius) of the circle through three points; null if they are in line."""
    d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    x = (a2 * (by - cy) + b2 * (cy - ay) + c2 * (ay - by)) / d
    y = (a2 * (cx - bx) + b2 * (ax - cx) + c2 * (bx - ax)) / d
    return F.when(F.abs(d) > 1e-12, F.struct(x.alias("x"), y.alias("y"), F.hypot(ax - x, ay - y).alias("radius")))


def svg_previews(polygons: DataFrame) -> DataFrame:
    """(mesh_id, svg) from polygons (mesh_id, place, points); the faces of a mesh are bounded by the scanner's limit."""
    shape = F.concat(F.lit('<polygon points="'), "points", F.lit('"/>'))
    drawn = F.transform(F.sort_array(F.collect_list(F.struct("place", shape.alias("shape")))), lambda s: s["shape"])
    text = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" fill="none" stroke="black">'), F.array_join(drawn, ""), F.lit("</svg>"))
    return polygons.groupBy("mesh_id").agg(text.alias("svg"))


def _glb(vertices: list[list[float]], faces: list[list[int]]) -> bytes:
    # fixed axes of the format: y is up, so (x, y, z) becomes (x, z, -y)
    points = b"".join(struct.pack("<3f", v[0], v[2], -v[1]) for v in vertices)
    index = b"".join(struct.pack("<3I", *f) for f in faces)
    turned = [[v[0], v[2], -v[1]] for v in vertices]
    document = {
        "asset": {"version": "2.0"},
        "buffers": [{"byteLength": len(points) + len(index)}],
        "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": len(points), "target": 34962}, {"buffer": 0, "byteOffset": len(points), "byteLength": len(index), "target": 34963}],
        "accessors": [
            {"bufferView": 0, "componentType": 5126, "count": len(vertices), "type": "VEC3", "min": [min(c) for c in zip(*turned)], "max": [max(c) for c in zip(*turned)]},
            {"bufferView": 1, "componentType": 5125, "count": 3 * len(faces), "type": "SCALAR"},
        ],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}],
        "nodes": [{"mesh": 0}],
        "scenes": [{"nodes": [0]}],
        "scene": 0,
    }
    text = json.dumps(document, sort_keys=True, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    body = points + index
    return struct.pack("<4sII", b"glTF", 2, 28 + len(text) + len(body)) + struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(body), b"BIN\0") + body


def glb_files(meshes: DataFrame) -> DataFrame:
    """(mesh_id, glb) of meshes (mesh_id, vertices array<array<double>>, faces array<array<int>>); empty ones give null."""
    kind = meshes.schema["mesh_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            files = [_glb(list(v), list(f)) if v is not None and len(v) and f is not None and len(f) else None for v, f in zip(frame["vertices"], frame["faces"])]
            yield pd.DataFrame({"mesh_id": frame["mesh_id"], "glb": files})

    return meshes.select("mesh_id", "vertices", "faces").mapInPandas(run, f"mesh_id {kind}, glb binary")


def attribute_state(text: Column) -> Column:
    """struct(state, value, reason_code) of an attribute as a model file writes it: $ is a null, * is derived elsewhere."""
    plain = F.regexp_replace(F.replace(text, F.lit("''"), F.lit("'")), "^'|'$", "")
    inner = F.regexp_extract(text, r"^[A-Z0-9_]+\((.*)\)$", 1)
    state = lambda s, v, r: F.struct(F.lit(s).alias("state"), v.alias("value"), F.lit(r).cast("string").alias("reason_code"))
    none = F.lit(None).cast("string")
    return (
        F.when(text.isNull() | (text == "$"), state("explicit_null", none, "SOURCE_NULL"))
        .when(text == "*", state("not_applicable", none, "SOURCE_DERIVED"))
        .when(text.rlike(r"^\.U\.$"), state("unknown", none, "SOURCE_UNKNOWN"))
        .when(text.rlike(r"^\.[A-Z0-9_]+\.$"), state("known", F.regexp_replace(text, r"\.", ""), None))
        .when(text.rlike(r"^[A-Z0-9_]+\(.*\)$"), state("known", F.regexp_replace(inner, "^'|'$", ""), None))
        .when(text.rlike(r"^('.*'|[-+]?[0-9.]+(E[-+]?[0-9]+)?|#[0-9]+)$"), state("known", plain, None))
        .otherwise(state("unsupported", none, "VALUE_FORM_UNSUPPORTED"))
    )


def georeference_state(conversions: Column, systems: Column, scale: Column, map_unit: Column, project_unit: Column) -> Column:
    """State of a model's place on the map by its numbers of conversions and reference systems, its scale and units."""
    return (
        F.when((conversions == 0) & (systems == 0), "none")
        .when((conversions > 1) | (systems > 1), "conflicted")
        .when((conversions == 0) | (systems == 0), "incomplete")
        .when(scale.isNull() & ~map_unit.eqNullSafe(project_unit), "unit_conflict")
        .otherwise("known")
    )


def derive_capabilities(observed: DataFrame) -> DataFrame:
    """(package_id, capability, level, reason, affected) from counts (package_id, capability, supported, total).

    full where all is supported (or there is nothing), partial where some is, opaque where nothing is; what isn't full
    comes with a reason and the number affected, for a loss diagnostic.
    """
    lost = F.col("total") - F.col("supported")
    level = F.when(lost <= 0, SUPPORT_LEVELS[3]).when(F.col("supported") > 0, SUPPORT_LEVELS[2]).otherwise(SUPPORT_LEVELS[1])
    reason = F.when(lost > 0, F.concat(F.upper("capability"), F.when(F.col("supported") > 0, "_PARTIAL").otherwise("_OPAQUE")))
    return observed.groupBy("package_id", "capability").agg(F.sum("supported").alias("supported"), F.sum("total").alias("total")).select("package_id", "capability", level.alias("level"), reason.alias("reason"), F.greatest(lost, F.lit(0)).alias("affected"))


def requirement_findings(instances: DataFrame, properties: DataFrame, requirements: list[dict]) -> DataFrame:
    """Findings (package_id, requirement, id, code) of model requirements over instances (package_id, id, original_class).

    A requirement has a name, an entity class, a property, and optionally a value, values, a pattern or bounds of a number;
    it applies to the class's instances, each of which needs the property (package_id, id, name, value). ``cardinality``
    prohibited turns it round; with optional only those that have the property must meet it.
    """
    bounds = {"minInclusive": lambda x, y: x >= y, "maxInclusive": lambda x, y: x <= y, "minExclusive": lambda x, y: x > y, "maxExclusive": lambda x, y: x < y}
    parts = [instances.limit(0).select("package_id", F.lit("").alias("requirement"), "id", F.lit("").alias("code"))]
    for r in requirements:
        chosen = instances.filter(F.col("original_class") == r["entity"]).select("package_id", "id").distinct()
        held = properties.filter(F.col("name") == r["property"])
        met = held
        if "value" in r:
            met = met.filter(F.col("value") == r["value"])
        if "values" in r:
            met = met.filter(F.col("value").isin(*r["values"]))
        if "pattern" in r:
            met = met.filter(F.col("value").rlike(f"^(?:{r['pattern']})$"))
        for name in bounds.keys() & r.keys():
            met = met.filter(bounds[name](F.col("value").try_cast("double"), F.lit(r[name])))
        if r.get("cardinality") == "optional":
            chosen = chosen.join(held.select("package_id", "id").distinct(), ["package_id", "id"], "left_semi")
        banned = r.get("cardinality") == "prohibited"
        bad = chosen.join(met.select("package_id", "id").distinct(), ["package_id", "id"], "left_semi" if banned else "left_anti")
        parts.append(bad.select("package_id", F.lit(r["name"]).alias("requirement"), "id", F.lit("REQUIREMENT_PROHIBITED" if banned else "REQUIREMENT_UNMET").alias("code")))
    return reduce(DataFrame.union, parts)
