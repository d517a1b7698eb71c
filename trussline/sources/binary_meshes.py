"""Triangles of mesh files that are bytes: binary STL, and scenes in glTF, as JSON or in one binary file."""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MAX_TRIANGLES = 5_000_000
BATCH_ROWS = 1 << 16
_FACET = np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("attribute", "<u2")])
#: Fixed values of the scene format: component types, components of an accessor, chunk marks, triangle modes.
_COMPONENTS = {5120: "<i1", 5121: "<u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
_WIDTHS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT4": 16}
_JSON_CHUNK, _BINARY_CHUNK = 0x4E4F534A, 0x004E4942
_TRIANGLES, _STRIP, _FAN = 4, 5, 6
MAX_DEPTH = 64


def is_binary_stl(content: bytes) -> bool:
    return len(content) >= 84 and len(content) == 84 + 50 * struct.unpack_from("<I", content, 80)[0]


def stl_corners(content: bytes) -> np.ndarray:
    """(triangles, 3, 3) of a binary STL file."""
    return np.frombuffer(content, _FACET, offset=84)["corners"].astype(float)


def _chunks(content: bytes) -> tuple[dict, bytes]:
    if content[:4] != b"glTF":
        return json.loads(content), b""
    version, total = struct.unpack_from("<II", content, 4)
    if version != 2:
        raise ValueError("MESH_VERSION_UNSUPPORTED")
    found, at = {}, 12
    while at + 8 <= min(total, len(content)):
        size, mark = struct.unpack_from("<II", content, at)
        found.setdefault(mark, content[at + 8 : at + 8 + size])
        at += 8 + size
    return json.loads(found[_JSON_CHUNK]), found.get(_BINARY_CHUNK, b"")


def _buffers(doc: dict, binary: bytes) -> list[bytes]:
    out = []
    for k, b in enumerate(doc.get("buffers", [])):
        uri = b.get("uri")
        if uri is None and k == 0:
            out.append(binary)
        elif uri is not None and uri.startswith("data:") and ";base64," in uri:
            out.append(base64.b64decode(uri.split(",", 1)[1], validate=True))
        else:
            raise ValueError("MESH_EXTERNAL_RESOURCE")
    return out


def _accessor(doc: dict, buffers: list[bytes], index: int) -> np.ndarray:
    a = doc["accessors"][index]
    if "sparse" in a:
        raise ValueError("MESH_ACCESSOR_UNSUPPORTED")
    view = doc["bufferViews"][a["bufferView"]]
    kind, width = np.dtype(_COMPONENTS[a["componentType"]]), _WIDTHS[a["type"]]
    start, stride = view.get("byteOffset", 0) + a.get("byteOffset", 0), view.get("byteStride") or kind.itemsize * width
    data = buffers[view["buffer"]]
    # the view refuses to reach past the buffer's end
    return np.ndarray((a["count"], width), kind, data, start, (stride, kind.itemsize))


def _matrix(node: dict) -> np.ndarray:
    if "matrix" in node:
        return np.array(node["matrix"], float).reshape(4, 4).T
    x, y, z, w = node.get("rotation", (0, 0, 0, 1))
    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    out = np.eye(4)
    out[:3, :3] = turn * np.array(node.get("scale", (1, 1, 1)), float)
    out[:3, 3] = node.get("translation", (0, 0, 0))
    return out


def _placed(doc: dict) -> Iterator[tuple[int, np.ndarray]]:
    """(mesh, matrix) for each place of a mesh in the scene; without scenes, every mesh once where it is."""
    nodes = doc.get("nodes", [])
    if not doc.get("scenes"):
        yield from ((k, np.eye(4)) for k in range(len(doc.get("meshes", []))))
        return
    waiting = [(n, np.eye(4), 0) for n in doc["scenes"][doc.get("scene", 0)].get("nodes", [])]
    while waiting:
        n, outer, depth = waiting.pop()
        if depth > MAX_DEPTH:
            raise ValueError("MESH_NODE_DEPTH")
        inner = outer @ _matrix(nodes[n])
        if "mesh" in nodes[n]:
            yield nodes[n]["mesh"], inner
        waiting += [(child, inner, depth + 1) for child in nodes[n].get("children", [])]


def gltf_corners(content: bytes) -> np.ndarray:
    """(triangles, 3, 3) of a scene in world coordinates; ValueError with a code where it can't be read."""
    doc, binary = _chunks(content)
    if doc.get("asset", {}).get("version") != "2.0":
        raise ValueError("MESH_VERSION_UNSUPPORTED")
    buffers, found, total = _buffers(doc, binary), [], 0
    for mesh, matrix in _placed(doc):
        for part in doc["meshes"][mesh]["primitives"]:
            points = _accessor(doc, buffers, part["attributes"]["POSITION"]).astype(float) @ matrix[:3, :3].T + matrix[:3, 3]
            index = _accessor(doc, buffers, part["indices"])[:, 0].astype(int) if "indices" in part else np.arange(len(points))
            mode = part.get("mode", _TRIANGLES)
            if mode == _TRIANGLES:
                index = index[: len(index) // 3 * 3].reshape(-1, 3)
            elif mode == _STRIP:
                index = np.stack([index[:-2], index[1:-1], index[2:]], 1)
                index[1::2] = index[1::2, [1, 0, 2]]
            elif mode == _FAN:
                index = np.stack([np.full(max(len(index) - 2, 0), index[0] if len(index) else 0), index[1:-1], index[2:]], 1)
            else:
                raise ValueError("MESH_MODE_UNSUPPORTED")
            total += len(index)
            if total > MAX_TRIANGLES:
                raise ValueError("MESH_TOO_LARGE")
            found.append(points[index])
    return np.concatenate(found) if found else np.empty((0, 3, 3))


def binary_triangles(files: DataFrame) -> DataFrame:
    """(package_id, path, vertex, x, y, z, error) of binary STL, glTF and GLB files, three rows a triangle.

    A file that can't be read has one row with its error: another format, JSON or bytes that don't hold together,
    resources outside of the file (they aren't opened), or more than five million triangles. Null content is no mesh.
    """
    fields = pa.schema([("package_id", pa.string()), ("path", pa.string()), ("vertex", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64()), ("error", pa.string())])

    def corners(content: bytes | None) -> np.ndarray:
        if content is not None and is_binary_stl(content):
            if len(content) > 84 + 50 * MAX_TRIANGLES:
                raise ValueError("MESH_TOO_LARGE")
            return stl_corners(content)
        if content is not None and (content[:4] == b"glTF" or content.lstrip()[:1] == b"{"):
            try:
                return gltf_corners(content)
            except (KeyError, IndexError, TypeError, AttributeError, struct.error, json.JSONDecodeError, UnicodeDecodeError, RecursionError) as problem:
                raise ValueError("MESH_PARSE_FAILED") from problem
        raise ValueError("MESH_FORMAT_UNSUPPORTED")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for package, path, content in zip(*(batch.column(k) for k in range(3))):
                try:
                    points = corners(content.as_py()).reshape(-1, 3)
                except ValueError as problem:
                    code = str(problem) if str(problem).startswith("MESH_") else "MESH_PARSE_FAILED"
                    yield pa.RecordBatch.from_pylist([{"package_id": package.as_py(), "path": path.as_py(), "error": code}], fields)
                    continue
                for at in range(0, len(points), BATCH_ROWS):
                    some = points[at : at + BATCH_ROWS]
                    n = len(some)
                    same = [pa.repeat(pa.scalar(v.as_py(), pa.string()), n) for v in (package, path)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(at, at + n)), *[pa.array(np.ascontiguousarray(some[:, k])) for k in range(3)], pa.nulls(n, pa.string())], schema=fields)

    return files.select(files["package_id"].cast("string"), "path", "content").mapInArrow(run, "package_id string, path string, vertex long, x double, y double, z double, error string")
