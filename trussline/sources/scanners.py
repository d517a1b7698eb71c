"""Source files as evidence rows: detection, opaque registration, STEP, IGES, DXF, meshes, rasters, bundles."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX = 65536


def detect(content: Column) -> Column:
    """Kind of a file by its first 64 KiB; the first rule that holds decides."""
    head = F.decode(F.substring(content, 1, PREFIX), "ISO-8859-1")
    up, start = F.upper(head), F.ltrim(head)
    step = up.contains("ISO-10303-21")
    iges = head.rlike(r"\A[^\r\n]{72}S[ 0-9]{7}\r?(\n|\z)")
    return (
        F.when(step & up.contains("FILE_SCHEMA") & up.contains("IFC"), "ifc")
        .when((step & up.contains("FILE_SCHEMA")) | iges, "step-iges")
        .when(head.rlike(r"\AAC10[0-9]{2}"), "dwg")
        .when(head.startswith("AutoCAD Binary DXF") | (head.contains("SECTION") & (head.contains("$ACADVER") | head.contains("HEADER"))), "dxf")
        .when(head.startswith("%PDF-"), "pdf")
        .when(head.startswith("glTF") | (start.startswith("{") & head.contains('"asset"') & head.contains('"version"')), "geometry")
        .when(F.lower(start).startswith("solid") & F.lower(head).contains("facet"), "geometry")
        .when(head.rlike(r"(?m)^v ") & head.rlike(r"(?m)^f "), "geometry")
        .when(head.rlike(r"\AP[1-6]") | head.startswith("\x89PNG\r\n\x1a\n") | head.startswith("\xff\xd8\xff"), "image")
        .otherwise("opaque")
    )


def register_opaque(files: DataFrame, policy: str = "external") -> DataFrame:
    """A source row for each file (package_id, path, content): hash, size, kind, and where its bytes are or why not."""
    stored = F.when(F.lit(policy == "embedded"), F.concat(F.lit("sources/"), F.sha2("content", 256))).when(F.lit(policy == "external"), F.col("path"))
    reason = F.when(F.lit(policy == "redacted"), "SOURCE_REDACTED")
    return files.select("package_id", "path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"), detect(F.col("content")).alias("kind"), F.lit(policy).alias("embedding_policy"), stored.alias("storage_ref"), reason.alias("redaction_reason"))


# ---- STEP and IFC


_STEP_TOKEN = re.compile(r"'(?:[^']|'')*'|/\*.*?\*/|[();]|[^'/();]+|/", re.DOTALL)
_STEP_STRING = r"'(?:[^']++|'')*+'"


def _bracketed(levels: int) -> str:
    """A pattern of brackets of at most so many levels without comments; no part is tried in two ways, so a text takes no longer than its length."""
    return rf"\((?:[^'/()]++|{_STEP_STRING}{'|' + _bracketed(levels - 1) if levels > 1 else ''})*+\)"


#: A statement, or a list of arguments, without comments or deep brackets; it needs no look at its tokens.
_PLAIN_STATEMENT = re.compile(rf"[^'/();]*+{_bracketed(3)}[^'/();]*+;")
_PLAIN_ARGUMENTS = re.compile(r"[^'/();]*+\(([^'/()]*+)\)")
_NESTED_ARGUMENTS = re.compile(rf"[^'/();]*+({_bracketed(3)})")
_ARGUMENT = re.compile(rf"((?:[^'/(),]++|{_STEP_STRING}|{_bracketed(2)})*+),")
_STRINGS = re.compile(_STEP_STRING)
_SIMPLE = re.compile(r"#([1-9][0-9]*)\s*=\s*([A-Z][A-Z0-9_]*)\s*\((.*)\)\s*;", re.DOTALL)
_COMPLEX = re.compile(r"#([1-9][0-9]*)\s*=\s*\((.*)\)\s*;", re.DOTALL)


def step_statements(text: str, max_depth: int = 64) -> Iterator[tuple[str, str]]:
    """(statement, the same without strings and comments) of a data section; ValueError if it doesn't parse."""
    raw: list[str] = []
    bare: list[str] = []
    depth = at = 0
    while at < len(text):
        if max_depth >= 3 and not raw and (m := _PLAIN_STATEMENT.match(text, at)):
            at, plain = m.end(), m[0].strip()
            yield plain, _STRINGS.sub(" ", plain)
            continue
        if not (m := _STEP_TOKEN.match(text, at)):
            break
        token, at = m[0], m.end()
        raw.append(token)
        bare.append(" " if token[0] == "'" or token.startswith("/*") else token)
        depth += (token == "(") - (token == ")")
        if not 0 <= depth <= max_depth:
            raise ValueError("STEP_DEPTH")
        if token == ";" and not depth:
            yield "".join(raw).strip(), "".join(bare).strip()
            raw, bare = [], []
    if at != len(text) or depth or "".join(raw).strip():
        raise ValueError("STEP_PARSE_FAILED")


def step_arguments(raw: str) -> list[str]:
    """The arguments between the outer brackets of a statement or list, as written; comments go, strings stay whole."""
    if m := _PLAIN_ARGUMENTS.match(raw):
        return [x.strip() for x in m[1].split(",")] if m[1].strip() else []
    if m := _NESTED_ARGUMENTS.match(raw):
        return [x.strip() for x in _ARGUMENT.findall(m[1][1:-1] + ",")]
    out: list[list[str]] = [[]]
    depth = 0
    for m in _STEP_TOKEN.finditer(raw):
        token = m[0]
        if token.startswith("/*"):
            continue
        depth += (token == "(") - (token == ")")
        if not depth:
            if token == ")":
                break
            continue
        if depth == 1 and token == "(":
            continue
        if depth == 1 and token[0] not in "'()":
            first, *others = token.split(",")
            out[-1].append(first)
            out += [[x] for x in others]
        else:
            out[-1].append(token)
    found = ["".join(x).strip() for x in out]
    return found if found != [""] else []


def scan_step(text: str) -> list[tuple[int, str, str, list[int], list[str] | None]]:
    """(id, class, statement, references, arguments) of the instances of a file; ValueError if it doesn't parse."""
    head, data = text.find("HEADER;"), text.find("DATA;")
    end = text.find("ENDSEC;", data)
    if not text.lstrip().startswith("ISO-10303-21;") or head < 0 or data < head or end < 0 or "END-ISO-10303-21;" not in text:
        raise ValueError("STEP_PARSE_FAILED")
    found = []
    for raw, bare in step_statements(text[data + 5 : end]):
        m = _SIMPLE.fullmatch(bare)
        many = None if m else _COMPLEX.fullmatch(bare)
        if not m and not many:
            raise ValueError("STEP_PARSE_FAILED")
        body = m[3] if m else many[2]
        found.append((int((m or many)[1]), m[2] if m else "COMPLEX_INSTANCE", raw, sorted({int(x) for x in re.findall(r"#([1-9][0-9]*)", body)}), step_arguments(raw) if m else None))
    if len({f[0] for f in found}) < len(found):
        raise ValueError("STEP_ENTITY_DUPLICATE")
    return found


_STEP_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.string()]
#: Instances that are handed over at once, about.
STEP_ROWS = 8192


def step_instances(files: DataFrame) -> DataFrame:
    """(package_id, path, id, original_class, raw, refs, args, lacking, error) of STEP files; one that doesn't parse gives an error row.

    ``args`` are the arguments as written; complex instances have none of their own. ``lacking`` are the references that no
    instance of the file has.
    """

    names = ["package_id", "path", "id", "original_class", "raw", "refs", "args", "lacking", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for package, path, content in zip(*(batch.column(c).to_pylist() for c in ("package_id", "path", "content"))):
                try:
                    found = scan_step(content.decode("latin-1"))
                    there = {row[0] for row in found}
                    rows += [(package, path, *row, [r for r in row[3] if r not in there], None) for row in found]
                except ValueError as problem:
                    rows.append((package, path, None, None, None, None, None, None, str(problem)))
                if len(rows) >= STEP_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _STEP_TYPES)], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _STEP_TYPES)], names)

    return files.select("package_id", "path", "content").mapInArrow(run, "package_id string, path string, id long, original_class string, raw string, refs array<long>, args array<string>, lacking array<long>, error string")


def dangling_instances(instances: DataFrame) -> DataFrame:
    """References of STEP instances that no instance of the file has; the scan of a file tells them, else a join does."""
    if "lacking" in instances.columns:
        return instances.select("package_id", "path", F.explode("lacking").alias("ref"), "id").select("package_id", "path", "ref", "id")
    refs = instances.select("package_id", "path", "id", F.explode("refs").alias("ref"))
    return refs.join(instances.select("package_id", "path", F.col("id").alias("ref")), ["package_id", "path", "ref"], "left_anti")


IFC_SPACES = ("IFCPROJECT", "IFCSITE", "IFCBUILDING", "IFCBUILDINGSTOREY", "IFCSPACE")


def ifc_kind(original_class: Column) -> Column:
    return F.when(original_class.isin(*IFC_SPACES), "spatial-container").when(original_class.rlike("^IFC(WALL|SLAB|BEAM|COLUMN|DOOR|WINDOW|STAIR|ROOF|COVERING|PLATE|MEMBER|RAILING|FOOTING|PILE)"), "solid-element").otherwise("opaque-object")


# ---- IGES


def iges_directory(files: DataFrame) -> DataFrame:
    """(package_id, path, sequence, entity_type, level, form, label, is_external) from pairs of 80-column directory cards."""
    text = F.decode("content", "ISO-8859-1")
    cards = files.select("package_id", "path", F.posexplode(F.split(text, "\r?\n")).alias("place", "card")).filter((F.length("card") == 80) & (F.substring("card", 73, 1) == "D"))
    w = Window.partitionBy("package_id", "path").orderBy("place")
    num = lambda c, at, n: F.coalesce(F.trim(F.substring(c, at, n)).try_cast("int"), F.lit(0))
    paired = cards.withColumns({"nth": F.row_number().over(w), "second": F.lead("card").over(w)}).filter("nth % 2 = 1 and second is not null")
    return paired.select(
        "package_id",
        "path",
        num("card", 74, 7).alias("sequence"),
        num("card", 1, 8).alias("entity_type"),
        num("card", 33, 8).alias("level"),
        num("second", 33, 8).alias("form"),
        F.trim(F.substring("second", 57, 8)).alias("label"),
        (num("card", 1, 8) == 416).alias("is_external"),
        ((num("second", 74, 7) == num("card", 74, 7) + 1) & (num("second", 1, 8) == num("card", 1, 8))).alias("is_paired"),
    )


# ---- DXF


# Drawing units by code, and neutral kinds by entity type.
DXF_UNITS = {1: "in", 2: "ft", 4: "mm", 5: "cm", 6: "m", 7: "km"}
DXF_KINDS = {
    "annotation": ("TEXT", "MTEXT", "ATTRIB", "ATTDEF", "DIMENSION"),
    "linear-element": ("LINE", "LWPOLYLINE", "POLYLINE", "ARC", "CIRCLE", "ELLIPSE", "SPLINE", "HELIX", "RAY", "XLINE"),
    "surface-element": ("HATCH", "SOLID", "TRACE", "3DFACE"),
}


def dxf_tags(files: DataFrame) -> DataFrame:
    """(package_id, path, place, code, value): the code and value lines of ASCII drawings, in pairs."""
    lines = F.split(F.decode("content", "UTF-8"), "\r?\n")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("lines") / 2).cast("int") - 1), lambda k: F.struct(F.trim(F.col("lines")[2 * k]).try_cast("int").alias("code"), F.trim(F.col("lines")[2 * k + 1]).alias("value")))
    rows = files.select("package_id", "path", lines.alias("lines")).filter(F.size("lines") >= 2)
    return rows.select("package_id", "path", F.posexplode(pairs).alias("place", "t")).select("package_id", "path", "place", "t.code", "t.value")


def dxf_entities(tags: DataFrame) -> DataFrame:
    """(package_id, path, nth, type, section, handle, layer, block, kind, numbers, series) of the entities of drawings.

    An entity begins at each code 0; the section and the block that it lies in are the last begun before. ``series`` maps
    numeric codes to all their values in order, ``numbers`` coordinate codes to their first values.
    """
    w = Window.partitionBy("package_id", "path").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.col("code") == 0
    before = F.lag("value").over(Window.partitionBy("package_id", "path").orderBy("place"))
    marked = tags.withColumns({"nth": F.sum(begins.cast("int")).over(w), "after_section": (F.col("code") == 2) & (before == "SECTION")})
    marked = marked.withColumn("section", F.last(F.when(F.col("after_section"), F.col("value")), ignorenulls=True).over(w))
    first = lambda code: F.min_by(F.when(F.col("code") == code, F.col("value")), F.when(F.col("code") == code, F.col("place")))
    held = F.array_sort(F.collect_list(F.when(_is_numeric(F.col("code")), F.struct("place", "code", F.col("value").try_cast("double").alias("number")))))
    return _with_series(marked.filter("nth > 0").groupBy("package_id", "path", "nth").agg(first(0).alias("type"), F.first("section").alias("section"), first(5).alias("handle"), first(8).alias("layer"), first(2).alias("block"), held.alias("held")))


def _is_numeric(code: Column) -> Column:
    return code.between(10, 99) | code.between(140, 149) | code.between(210, 239) | code.between(280, 299)


def _with_series(grouped: DataFrame) -> DataFrame:
    """Entities with ``series`` and ``numbers`` in place of the numeric pairs in ``held``, and their kind; those of other sections are left out."""
    series = F.map_from_arrays(F.array_distinct(F.col("held")["code"]), F.transform(F.array_distinct(F.col("held")["code"]), lambda c: F.filter("held", lambda t: t["code"] == c)["number"]))
    grouped = grouped.withColumn("series", series).drop("held")
    grouped = grouped.withColumn("numbers", F.transform_values(F.map_filter("series", lambda c, v: c < 60), lambda c, v: v[0]))
    kind = F.lit("opaque-object")
    for name, types in DXF_KINDS.items():
        kind = F.when(F.col("type").isin(*types), name).otherwise(kind)
    return grouped.filter("section in ('ENTITIES', 'BLOCKS') and type not in ('SECTION', 'ENDSEC', 'EOF')").withColumn("kind", kind)


def drawing_entities(files: DataFrame) -> DataFrame:
    """The rows of :func:`dxf_entities` straight from ASCII drawings.

    A file is one row already, so its pairs are cut at each code 0 where they stand and nothing is dealt out or sorted.
    """
    lines = F.split(F.decode("content", "UTF-8"), "\r?\n")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("lines") / 2).cast("int") - 1), lambda k: F.struct(F.trim(F.col("lines")[2 * k]).try_cast("int").alias("code"), F.trim(F.col("lines")[2 * k + 1]).alias("value")))
    rows = files.select("package_id", "path", lines.alias("lines")).filter(F.size("lines") >= 2).select("package_id", "path", pairs.alias("tags"))
    places = F.transform("tags", lambda t, k: F.struct(k.alias("k"), t["code"].alias("code"), t["value"].alias("value")))
    begins = F.filter(places, lambda t: t["code"] == 0)["k"]
    named = F.filter(places, lambda t: (t["code"] == 2) & (F.get("tags", t["k"] - 1)["value"] == "SECTION"))
    marked = rows.select("package_id", "path", "tags", begins.alias("begins"), named.alias("named"))
    cut = F.transform(
        "begins",
        lambda b, i: F.struct(
            (i + 1).cast("long").alias("nth"),
            F.slice("tags", b + 1, F.coalesce(F.get("begins", i + 1), F.size("tags")) - b).alias("own"),
            F.try_element_at(F.filter("named", lambda t: t["k"] < b), F.lit(-1))["value"].alias("section"),
        ),
    )
    # an outer explode, as the plain one would have the array made once more to see whether it is empty
    each = marked.select("package_id", "path", F.explode_outer(cut).alias("e")).filter("e is not null").select("package_id", "path", "e.*")
    first = lambda code: F.get(F.filter("own", lambda t: t["code"] == code), 0)["value"]
    held = F.transform(F.filter("own", lambda t: _is_numeric(t["code"])), lambda t: F.struct(t["code"].alias("code"), t["value"].try_cast("double").alias("number")))
    listed = each.select("package_id", "path", "nth", F.col("own")[0]["value"].alias("type"), "section", first(5).alias("handle"), first(8).alias("layer"), first(2).alias("block"), held.alias("held"))
    return _with_series(listed)


def dxf_unit(code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in DXF_UNITS.items() for x in pair]), code)


# ---- meshes


def obj_mesh(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (package_id, path, vertex, x, y, z) and triangles (package_id, path, face, a, b, c) of OBJ texts.

    Polygons become fans; indices count from one, and negative ones back from the last vertex before.
    """
    lines = files.select("package_id", "path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\r?\n")).alias("place", "line"))
    parts = F.split(F.trim("line"), r"\s+")
    w = Window.partitionBy("package_id", "path").orderBy("place")
    kept = lines.withColumn("f", parts).filter(F.col("f")[0].isin("v", "f"))
    kept = kept.withColumns({"seen": F.sum((F.col("f")[0] == "v").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "is_v": F.col("f")[0] == "v"})
    v = kept.filter("is_v").select("package_id", "path", (F.col("seen") - 1).alias("vertex"), *[F.try_element_at("f", F.lit(k + 2)).try_cast("double").alias(c) for k, c in enumerate(("x", "y", "z"))])
    index = F.transform(F.slice("f", 2, F.size("f") - 1), lambda x: F.split(x, "/")[0].try_cast("int"))
    zero_based = F.transform("i", lambda x: F.when(x < 0, F.col("seen") + x).otherwise(x - 1))
    fan = F.explode(F.transform(F.sequence(F.lit(1), F.size("i") - 2), lambda k: F.struct(F.col("i")[0].alias("a"), F.get("i", k).alias("b"), F.get("i", k + 1).alias("c"))))
    f = kept.filter(~F.col("is_v")).withColumn("i", index).filter(F.size("i") >= 3).withColumn("i", zero_based)
    return v, f.select("package_id", "path", F.col("place").alias("face"), fan.alias("t")).select("package_id", "path", "face", "t.*")


def stl_triangles(files: DataFrame) -> DataFrame:
    """(package_id, path, vertex, x, y, z) of the corners of ASCII STL facets, three in a row a triangle."""
    lines = files.select("package_id", "path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\r?\n")).alias("place", "line"))
    kept = lines.withColumn("f", F.split(F.trim("line"), r"\s+")).filter(F.lower(F.col("f")[0]) == "vertex")
    nth = F.row_number().over(Window.partitionBy("package_id", "path").orderBy("place")) - 1
    return kept.select("package_id", "path", nth.alias("vertex"), *[F.try_element_at("f", F.lit(k + 2)).try_cast("double").alias(c) for k, c in enumerate(("x", "y", "z"))])


def gltf_summary(files: DataFrame) -> DataFrame:
    """(package_id, path, version, n_meshes, n_external, error) of glTF JSON; resources outside the file aren't opened."""
    doc = F.try_parse_json(F.decode("content", "UTF-8"))
    get = lambda p, kind: F.try_variant_get("doc", p, kind)
    rows = files.select("package_id", "path", doc.alias("doc"))
    uris = F.concat(*[F.coalesce(get(f"$.{k}", "array<struct<uri:string>>")["uri"], F.array().cast("array<string>")) for k in ("buffers", "images")])
    external = F.size(F.filter(uris, lambda u: u.isNotNull() & ~u.startswith("data:")))
    error = F.when(F.col("doc").isNull(), "MESH_PARSE_FAILED").when(~F.coalesce(get("$.asset.version", "string") == "2.0", F.lit(False)), "MESH_VERSION_UNSUPPORTED").when(external > 0, "MESH_EXTERNAL_RESOURCE")
    return rows.select("package_id", "path", get("$.asset.version", "string").alias("version"), F.coalesce(F.size(get("$.meshes", "array<variant>")), F.lit(0)).alias("n_meshes"), external.alias("n_external"), error.alias("error"))


# ---- rasters


def raster_headers(files: DataFrame) -> DataFrame:
    """(package_id, path, format, width, height, depth, error) of PBM, PGM, PPM and PNG files, up to 100 million pixels."""
    head = F.decode(F.substring("content", 1, 4096), "ISO-8859-1")
    clean = F.regexp_replace(head, r"#[^\n]*\n", " ")
    bits = lambda k: F.regexp_extract(clean, r"\A(P[14])\s+(\d+)\s+(\d+)\s", k)
    pnm = lambda k: F.regexp_extract(clean, r"\A(P[2356])\s+(\d+)\s+(\d+)\s+(\d+)\s", k)
    number = lambda at, n: F.conv(F.hex(F.substring("content", at, n)), 16, 10).cast("long")
    png = head.startswith("\x89PNG\r\n\x1a\n")
    kind = F.when(png, "PNG").when(pnm(1).isin("P2", "P5"), "PGM").when(pnm(1).isin("P3", "P6"), "PPM").when(bits(1) != "", "PBM")
    side = lambda at, k: F.when(png, number(at, 4)).otherwise(F.coalesce(pnm(k).try_cast("long"), bits(k).try_cast("long")))
    most = pnm(4).try_cast("long")
    depth = F.when(png, number(25, 1)).when(kind == "PBM", 1).otherwise(F.when(most > 255, 16).otherwise(8))
    rows = files.select("package_id", "path", kind.alias("format"), side(17, 2).alias("width"), side(21, 3).alias("height"), depth.cast("int").alias("depth"), most.alias("most"))
    error = F.when(F.col("format").isNull(), "IMAGE_FORMAT_UNSUPPORTED").when((F.col("width") < 1) | (F.col("height") < 1), "IMAGE_EMPTY").when(~F.col("most").between(1, 65535), "IMAGE_HEADER_INVALID")
    return rows.withColumn("error", error.when(F.col("width") * F.col("height") > 100_000_000, "IMAGE_TOO_LARGE")).drop("most")


# ---- bundles


def check_bundles(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(package_id, code, path) for bundles: entries (package_id, path, role, bytes, sha256) against files of the same keys.

    Exactly one root, at most 32 entries, each there with its size and hash, and no file beside them.
    """
    counts = entries.groupBy("package_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "root").alias("roots"))
    found = files.select("package_id", "path", F.col("bytes").alias("is_bytes"), F.col("sha256").alias("is_sha"))
    both = entries.join(found, ["package_id", "path"], "left")
    row = lambda rows, code, path="path": rows.select("package_id", F.lit(code).alias("code"), F.expr(path).alias("path"))
    parts = [row(counts.filter("roots <> 1"), "BUNDLE_ROOT_INVALID", "''"), row(counts.filter("n > 32"), "BUNDLE_TOO_MANY_ENTRIES", "''"), row(both.filter("is_sha is null"), "BUNDLE_ENTRY_MISSING"), row(both.filter("is_sha is not null and (bytes <> is_bytes or sha256 <> is_sha)"), "BUNDLE_ENTRY_MISMATCH")]
    out = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return out.union(row(files.join(entries.select("package_id", "path"), ["package_id", "path"], "left_anti"), "BUNDLE_FILE_UNLISTED"))


def strict_json(text: str) -> object:
    """A control document: JSON without repeated keys or non-finite numbers."""

    def unique(pairs: list[tuple[str, object]]) -> dict[str, object]:
        if len(dict(pairs)) < len(pairs):
            raise ValueError("a key repeats")
        return dict(pairs)

    def refuse(name: str) -> object:
        raise ValueError(f"{name} is no JSON number")

    return json.loads(text, object_pairs_hook=unique, parse_constant=refuse)
