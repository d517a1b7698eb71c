"""Plane geometry of building models: curves, fills, texts and mapped items, evaluated from their parts upwards.

The instances of a file refer to each other without loops. Each is evaluated once all that it names has been, so shared parts are
worked out once; what a loop never lets become ready is told as such.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.sources.scanners import STEP_ROWS, scan_step, step_arguments

#: Parts of a whole turn, points of an item, members of a set, characters of a text, and levels of reference.
TURN_PARTS, POINTS, MEMBERS, TEXT, DEPTH = 64, 100_000, 4096, 65_536, 32
FAILED, CYCLE, TOO_DEEP, TOO_MANY, TEXT_LIMIT = "IFC_2D_EXTRACTION_FAILED", "IFC_2D_REFERENCE_CYCLE", "IFC_2D_REFERENCE_DEPTH_EXCEEDED", "IFC_2D_POINT_LIMIT_EXCEEDED", "IFC_2D_TEXT_LIMIT_EXCEEDED"

Path = list[list[float]]
Frame = tuple[float, float, float, float, float, float]  # x' = a x + b y + c, y' = d x + e y + f


class Fault(ValueError):
    """The reason why an instance has no geometry."""


def _need(good: object, reason: str = FAILED) -> None:
    if not good:
        raise Fault(reason)


def _number(text: str) -> float:
    inner = re.fullmatch(r"(?:[A-Z0-9_]+\s*\(\s*)?([-+0-9.eE]+)\s*\)?", text)
    _need(inner)
    value = float(inner[1])
    _need(math.isfinite(value))
    return value


def _list(text: str) -> list[str]:
    _need(text.startswith("("))
    return step_arguments(text)


def _unit(v: list[float]) -> list[float]:
    size = math.hypot(*v)
    _need(size > 0)
    return [x / size for x in v]


def _apply(frame: Frame, p: list[float]) -> list[float]:
    a, b, c, d, e, f = frame
    return [a * p[0] + b * p[1] + c, d * p[0] + e * p[1] + f]


def _product(x: Frame, y: Frame) -> Frame:
    a, b, c, d, e, f = x
    g, h, i, j, k, m = y
    return a * g + b * j, a * h + b * k, a * i + b * m + c, d * g + e * j, d * h + e * k, d * i + e * m + f


def _inverse(x: Frame) -> Frame:
    a, b, c, d, e, f = x
    det = a * e - b * d
    _need(abs(det) > 1e-15)
    a, b, d, e = e / det, -b / det, -d / det, a / det
    return a, b, -(a * c + b * f), d, e, -(d * c + e * f)


class Plane:
    """What evaluated instances of a file stand for; a handler reads its arguments and what they name."""

    def __init__(self, angle: float):
        self.angle = angle
        self.done: dict[int, object] = {}
        self.faults: dict[int, str] = {}

    def at(self, text: str) -> object:
        m = re.fullmatch(r"#([0-9]+)", text.strip())
        _need(m)
        found = self.done.get(int(m[1]))
        _need(found is not None)
        return found

    def point(self, a: list[str]) -> list[float]:
        values = [_number(x) for x in _list(a[0])]
        _need(len(values) in (2, 3))
        return values

    def point_list(self, a: list[str]) -> Path:
        points = [[_number(x) for x in _list(p)] for p in _list(a[0])]
        _need(all(len(p) == 2 for p in points))
        _need(len(points) <= POINTS, TOO_MANY)
        return points

    def placement(self, a: list[str]) -> Frame:
        x, y = self.at(a[0])[:2]
        c, s = _unit(self.at(a[1])[:2]) if a[1] != "$" else (1.0, 0.0)
        return c, -s, x, s, c, y

    def operator(self, a: list[str]) -> Frame:
        x, y = self.at(a[2])[:2]
        c, s = _unit(self.at(a[0])[:2]) if a[0] != "$" else (1.0, 0.0)
        scale = _number(a[3]) if len(a) > 3 and a[3] != "$" else 1.0
        other = _number(a[4]) if len(a) > 4 and a[4] != "$" else scale
        _need(scale > 0 and other > 0)
        side = 1.0
        if a[1] != "$":
            u, v = self.at(a[1])[:2]
            side = 1.0 if c * v - s * u >= 0 else -1.0
        return c * scale, -s * side * other, x, s * scale, c * side * other, y

    def polyline(self, a: list[str]) -> tuple[str, list[Path]]:
        points = [list(self.at(p))[:2] for p in _list(a[0])]
        _need(len(points) >= 2)
        return "polyline", [points]

    def indexed(self, a: list[str]) -> tuple[str, list[Path]]:
        points = self.at(a[0])
        _need(isinstance(points, list) and points and isinstance(points[0], list))
        if len(a) < 2 or a[1] == "$":
            return "indexed_polycurve", [points]
        paths = []
        for segment in _list(a[1]):
            m = re.fullmatch(r"(?s)(IFCLINEINDEX|IFCARCINDEX)\s*\((.*)\)", segment)
            _need(m)
            places = [int(x) for x in _list(m[2].strip())]
            _need(all(1 <= k <= len(points) for k in places))
            chosen = [points[k - 1] for k in places]
            if m[1] == "IFCLINEINDEX":
                _need(len(chosen) >= 2)
                paths.append(chosen)
            else:
                _need(len(chosen) == 3)
                paths.append(self._through(*chosen))
        return "indexed_polycurve", paths

    def _through(self, p: list[float], q: list[float], r: list[float]) -> Path:
        """The arc from p over q to r."""
        (ax, ay), (bx, by), (cx, cy) = p, q, r
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        _need(abs(d) > 1e-12)
        x = ((ax * ax + ay * ay) * (by - cy) + (bx * bx + by * by) * (cy - ay) + (cx * cx + cy * cy) * (ay - by)) / d
        y = ((ax * ax + ay * ay) * (cx - bx) + (bx * bx + by * by) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)) / d
        start, end = math.atan2(ay - y, ax - x), math.atan2(cy - y, cx - x)
        left = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) > 0
        span = (end - start) % (2 * math.pi) if left else -((start - end) % (2 * math.pi))
        path = self._conic((1.0, 0.0, x, 0.0, 1.0, y), math.hypot(ax - x, ay - y), math.hypot(ax - x, ay - y), start, span)
        return [list(p), *path[1:-1], list(r)]

    def _conic(self, frame: Frame, a: float, b: float, start: float, span: float) -> Path:
        n = max(2, math.ceil(abs(span) / (2 * math.pi) * TURN_PARTS - 1e-9))
        return [_apply(frame, [a * math.cos(start + span * k / n), b * math.sin(start + span * k / n)]) for k in range(n + 1)]

    def _basis(self, a: list[str], ellipse: bool) -> dict:
        radii = [_number(x) for x in a[1 : 3 if ellipse else 2]]
        frame = self.at(a[0])
        _need(len(frame) == 6 and all(r > 0 for r in radii))
        return {"kind": "ellipse" if ellipse else "circle", "frame": frame, "radii": (radii[0], radii[-1])}

    def circle(self, a: list[str]) -> dict:
        return self._basis(a, False)

    def ellipse(self, a: list[str]) -> dict:
        return self._basis(a, True)

    def trimmed(self, a: list[str]) -> tuple[str, list[Path]]:
        basis = self.at(a[0])
        _need(isinstance(basis, dict) and a[4] == ".PARAMETER.")
        ends = []
        for trim in a[1:3]:
            values = [x for x in _list(trim) if not x.startswith("#")]
            _need(len(values) == 1)
            ends.append(_number(values[0]) * self.angle)
        start, end = ends if a[3] == ".T." else ends[::-1]
        span = (end - start) % (2 * math.pi) or 2 * math.pi
        return "trimmed_curve", [self._conic(basis["frame"], *basis["radii"], start, span)]

    def paths(self, text: str) -> list[Path]:
        """The paths of what an argument names."""
        found = self.at(text)
        if isinstance(found, dict) and "radii" in found:
            return [self._conic(found["frame"], *found["radii"], 0.0, 2 * math.pi)]
        _need(isinstance(found, tuple) and isinstance(found[0], str))
        return found[1]

    def segment(self, a: list[str]) -> tuple[str, list[Path]]:
        paths = self.paths(a[2])
        return "segment", paths if a[1] == ".T." else [p[::-1] for p in reversed(paths)]

    def _many(self, kind: str, names: list[str]) -> tuple[str, list[Path]]:
        _need(len(names) <= MEMBERS)
        paths = [p for x in names for p in self.paths(x)]
        _need(sum(map(len, paths)) <= POINTS, TOO_MANY)
        return kind, paths

    def composite(self, a: list[str]) -> tuple[str, list[Path]]:
        names = _list(a[0])
        _need(names)
        return self._many("composite_curve", names)

    def fill(self, a: list[str]) -> tuple[str, list[Path]]:
        return self._many("annotation_fill_area", [a[0], *(_list(a[1]) if len(a) > 1 and a[1] != "$" else [])])

    def curve_set(self, a: list[str]) -> tuple[str, list[Path]]:
        return self._many("geometric_curve_set", sorted(_list(a[0]), key=lambda x: int(x.strip("# "))))

    def text(self, a: list[str]) -> tuple[str, list[Path]]:
        _need(a[0].startswith("'") and a[2] in (".LEFT.", ".RIGHT.", ".UP.", ".DOWN."))
        _need(len(a[0]) - 2 <= TEXT, TEXT_LIMIT)
        _need(len(self.at(a[1])) == 6)
        return "text_literal", []

    def representation(self, a: list[str]) -> tuple[str, list[Path]]:
        return self._many("representation", _list(a[3]))

    def representation_map(self, a: list[str]) -> tuple[Frame, list[Path]]:
        return self.at(a[0]), self.paths(a[1])

    def mapped(self, a: list[str]) -> tuple[str, list[Path]]:
        source, target = self.at(a[0]), self.at(a[1])
        _need(isinstance(source, tuple) and len(source) == 2 and len(target) == 6)
        frame = _product(target, _inverse(source[0]))
        return "mapped_item", [[_apply(frame, p) for p in path] for path in source[1]]


# The classes of plane geometry.
HANDLERS: dict[str, Callable[[Plane, list[str]], object]] = {
    "IFCCARTESIANPOINT": Plane.point,
    "IFCDIRECTION": Plane.point,
    "IFCCARTESIANPOINTLIST2D": Plane.point_list,
    "IFCAXIS2PLACEMENT2D": Plane.placement,
    "IFCCARTESIANTRANSFORMATIONOPERATOR2D": Plane.operator,
    "IFCCARTESIANTRANSFORMATIONOPERATOR2DNONUNIFORM": Plane.operator,
    "IFCPOLYLINE": Plane.polyline,
    "IFCINDEXEDPOLYCURVE": Plane.indexed,
    "IFCCIRCLE": Plane.circle,
    "IFCELLIPSE": Plane.ellipse,
    "IFCTRIMMEDCURVE": Plane.trimmed,
    "IFCCOMPOSITECURVESEGMENT": Plane.segment,
    "IFCCOMPOSITECURVE": Plane.composite,
    "IFCANNOTATIONFILLAREA": Plane.fill,
    "IFCTEXTLITERAL": Plane.text,
    "IFCGEOMETRICCURVESET": Plane.curve_set,
    "IFCGEOMETRICSET": Plane.curve_set,
    "IFCSHAPEREPRESENTATION": Plane.representation,
    "IFCREPRESENTATIONMAP": Plane.representation_map,
    "IFCMAPPEDITEM": Plane.mapped,
}
#: Classes that only serve others.
PARTS = {"IFCCARTESIANPOINT", "IFCDIRECTION", "IFCCARTESIANPOINTLIST2D", "IFCAXIS2PLACEMENT2D", "IFCCARTESIANTRANSFORMATIONOPERATOR2D", "IFCCARTESIANTRANSFORMATIONOPERATOR2DNONUNIFORM", "IFCCOMPOSITECURVESEGMENT", "IFCREPRESENTATIONMAP"}


def evaluate(rows: list[tuple[int, str, list[str], list[int]]], angle: float = 1.0) -> dict[int, tuple[str | None, list[Path] | None, str | None]]:
    """{id: (kind, paths, reason)} of the instances (id, class, args, refs) of a file; ``angle`` is the file's angle unit in radians."""
    plane = Plane(angle)
    known = {k: (kind, args, refs) for k, kind, args, refs in rows}
    waits = {k: {r for r in refs if r in known} for k, (_, _, refs) in known.items()}
    users: dict[int, list[int]] = {}
    for k, needed in waits.items():
        for r in needed:
            users.setdefault(r, []).append(k)
    ready, height = deque(sorted(k for k, needed in waits.items() if not needed)), dict.fromkeys(known, 0)
    finished = set()
    while ready:
        k = ready.popleft()
        finished.add(k)
        kind, args, refs = known[k]
        try:
            _need(height[k] <= DEPTH, TOO_DEEP)
            plane.done[k] = HANDLERS[kind](plane, args)
        except (Fault, ValueError, IndexError, TypeError, OverflowError) as problem:
            below = [plane.faults[r] for r in refs if plane.faults.get(r) in (TOO_DEEP, TOO_MANY, TEXT_LIMIT)]
            plane.faults[k] = below[0] if below else str(problem) if isinstance(problem, Fault) else FAILED
        for user in users.get(k, []):
            height[user] = max(height[user], height[k] + 1)
            waits[user].discard(k)
            if not waits[user]:
                ready.append(user)
    out = {}
    for k, (kind, _, _) in known.items():
        if kind in PARTS:
            continue
        found = plane.done.get(k)
        if k not in finished:
            out[k] = None, None, CYCLE
        elif found is None:
            out[k] = None, None, plane.faults[k]
        elif isinstance(found, dict):
            out[k] = found["kind"], plane.paths(f"#{k}"), None
        else:
            out[k] = found[0], found[1], None
    return out


_OUT = pa.schema([("package_id", pa.string()), ("path", pa.string()), ("id", pa.int64()), ("original_class", pa.string()), ("kind", pa.string()), ("paths", pa.list_(pa.list_(pa.list_(pa.float64())))), ("reason", pa.string())])


_OUT_SQL = "package_id string, path string, id long, original_class string, kind string, paths array<array<array<double>>>, reason string"


def _items(package: str, path: str, rows: list[tuple[int, str, list[str], list[int]]], angle: float) -> list[tuple]:
    """The rows of a file's plane items, in order."""
    classes = {k: kind for k, kind, _, _ in rows}
    return [(package, path, k, classes[k], *found) for k, found in sorted(evaluate(rows, angle).items())]


def _path_lists(found: list[list[Path] | None]) -> pa.Array:
    paths = [p for some in found if some for p in some]
    points = [q for p in paths for q in p]
    array = pa.array([x for q in points for x in q], pa.float64())
    each = [some or () for some in found]
    for parts in (points, paths, each):
        ends = pa.array(np.cumsum([0, *map(len, parts)], dtype=np.int32))
        array = pa.ListArray.from_arrays(ends, array, mask=pa.array([some is None for some in found]) if parts is each else None)
    return array


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = dict(zip(_OUT.names, zip(*rows)))
    return pa.RecordBatch.from_arrays([_path_lists(c) if n == "paths" else pa.array(c, _OUT.field(n).type) for n, c in columns.items()], schema=_OUT)


def plane_geometry(instances: DataFrame, angle: float = 1.0) -> DataFrame:
    """(package_id, path, id, original_class, kind, paths, reason) of plane items of parsed files; a reason stands where there are no paths.

    Only the instances of plane geometry leave the scan; those of one file meet in one task, as its text did.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        made = _items(rows[0]["package_id"], rows[0]["path"], [(r["id"], r["original_class"], r["args"] or [], r["refs"] or []) for r in rows], angle)
        return pa.Table.from_batches([_batch(made)] if made else [], _OUT)

    rows = instances.filter(F.col("original_class").isin(*HANDLERS)).select("package_id", "path", "id", "original_class", "args", "refs")
    return rows.groupBy("package_id", "path").applyInArrow(run, _OUT_SQL)


def file_geometry(files: DataFrame, angle: float = 1.0) -> DataFrame:
    """The rows of :func:`plane_geometry` straight from STEP files: each is parsed and evaluated where it stands, many in a batch.

    Files that don't parse have no rows; their errors are told by :func:`scanners.step_instances`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        points = 0
        for batch in batches:
            for package, path, content in zip(*(batch.column(c).to_pylist() for c in ("package_id", "path", "content"))):
                try:
                    found = scan_step(content.decode("latin-1"))
                except ValueError:
                    continue
                made = _items(package, path, [(k, kind, args or [], refs) for k, kind, _, refs, args in found if kind in HANDLERS], angle)
                out += made
                points += sum(len(p) for row in made for p in row[5] or ())
                if points >= POINTS or len(out) >= STEP_ROWS:
                    yield _batch(out)
                    out, points = [], 0
        if out:
            yield _batch(out)

    return files.select("package_id", "path", "content").mapInArrow(run, _OUT_SQL)
