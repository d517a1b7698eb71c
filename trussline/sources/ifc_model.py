"""Building models from parsed STEP instances: relations with the roles of their ends, and property sets joined to elements."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussline.sources.scanners import scan_step
from trussline.storage import joined

KEYS = ["package_id", "path"]

# Relation classes and the neutral relation that each stands for.
IFC_RELATIONS = {
    "IFCRELAGGREGATES": "aggregation",
    "IFCRELCONTAINEDINSPATIALSTRUCTURE": "containment",
    "IFCRELDEFINESBYTYPE": "type-assignment",
    "IFCRELASSOCIATESMATERIAL": "material-assignment",
    "IFCRELCONNECTSELEMENTS": "connection",
}
# The attributes of relation classes that name their ends, by place.
IFC_ENDS = {
    "IFCRELAGGREGATES": {4: "RelatingObject", 5: "RelatedObjects"},
    "IFCRELNESTS": {4: "RelatingObject", 5: "RelatedObjects"},
    "IFCRELCONTAINEDINSPATIALSTRUCTURE": {4: "RelatedElements", 5: "RelatingStructure"},
    "IFCRELREFERENCEDINSPATIALSTRUCTURE": {4: "RelatedElements", 5: "RelatingStructure"},
    "IFCRELDEFINESBYTYPE": {4: "RelatedObjects", 5: "RelatingType"},
    "IFCRELDEFINESBYPROPERTIES": {4: "RelatedObjects", 5: "RelatingPropertyDefinition"},
    "IFCRELASSOCIATESMATERIAL": {4: "RelatedObjects", 5: "RelatingMaterial"},
    "IFCRELASSOCIATESCLASSIFICATION": {4: "RelatedObjects", 5: "RelatingClassification"},
    "IFCRELASSOCIATESDOCUMENT": {4: "RelatedObjects", 5: "RelatingDocument"},
    "IFCRELASSIGNSTOGROUP": {4: "RelatedObjects", 6: "RelatingGroup"},
    "IFCRELCONNECTSELEMENTS": {5: "RelatingElement", 6: "RelatedElement"},
    "IFCRELCONNECTSPATHELEMENTS": {5: "RelatingElement", 6: "RelatedElement"},
    "IFCRELVOIDSELEMENT": {4: "RelatingBuildingElement", 5: "RelatedOpeningElement"},
    "IFCRELFILLSELEMENT": {4: "RelatingOpeningElement", 5: "RelatedBuildingElement"},
    "IFCRELSPACEBOUNDARY": {4: "RelatingSpace", 5: "RelatedBuildingElement"},
}
#: Property classes, and which of their arguments hold values and the unit.
SINGLE, ENUMERATED, LISTED, BOUNDED = "IFCPROPERTYSINGLEVALUE", "IFCPROPERTYENUMERATEDVALUE", "IFCPROPERTYLISTVALUE", "IFCPROPERTYBOUNDEDVALUE"
COMPLEX_DEPTH = 4
#: Bytes of rows that are handed over at once, and of texts and their rows that a task keeps for files that equal them, about.
BATCH_BYTES = 8_388_608


def argument(place: int | Column) -> Column:
    """An argument as written; null where it is ``$``, ``*`` or missing."""
    text = F.get("args", place if isinstance(place, Column) else F.lit(place))
    return F.when(~text.isin("$", "*"), text)


def references(text: Column) -> Column:
    """The instance numbers that an argument names, outside strings."""
    bare = F.regexp_replace(text, r"'(?:[^']|'')*'", "")
    return F.coalesce(F.transform(F.regexp_extract_all(bare, F.lit(r"#([1-9][0-9]*)"), F.lit(1)), lambda x: x.cast("long")), F.array().cast("array<long>"))


def string_value(text: Column) -> Column:
    """A STEP string without its quotes and with its escapes read; null for anything else.

    ``\\X\\hh`` is a Latin-1 byte, ``\\X2\\...\\X0\\`` are UTF-16 units, ``\\S\\c`` is c with its high bit set.
    """
    inner = F.replace(F.replace(F.substring(text, F.lit(2), F.length(text) - 2), F.lit("''"), F.lit("'")), F.lit("\\\\"), F.lit("\x01"))
    parts = F.regexp_extract_all(inner, F.lit(r"(?s)(\\X2\\[0-9A-F]*\\X0\\|\\X\\[0-9A-F]{2}|\\S\\.|[^\\]+|\\)"), F.lit(1))

    def read(x: Column) -> Column:
        units = F.decode(F.unhex(F.regexp_extract(x, r"\\X2\\([0-9A-F]*)\\X0\\", 1)), "UTF-16BE")
        latin = F.decode(F.unhex(F.substring(x, 4, 2)), "ISO-8859-1")
        high = F.char(F.ascii(F.substring(x, 4, 1)) + 128)
        return F.when(x.startswith("\\X2\\"), units).when(x.startswith("\\X\\"), latin).when(x.startswith("\\S\\"), high).otherwise(x)

    plain = F.replace(inner, F.lit("\x01"), F.lit("\\"))
    whole = F.when(inner.contains("\\"), F.replace(F.array_join(F.transform(parts, read), ""), F.lit("\x01"), F.lit("\\"))).otherwise(plain)
    return F.when(text.startswith("'"), whole)


def measure(text: Column) -> Column:
    """The measure type of ``IFCLABEL('x')``; null for values without one."""
    return F.nullif(F.regexp_extract(text, r"\A([A-Z][A-Z0-9_]*)\s*\(", 1), F.lit(""))


def plain_value(text: Column) -> Column:
    """The value of an argument as text: strings read, measures unwrapped, enumerations without dots; null where there is none."""
    inner = F.trim(F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)\A[A-Z][A-Z0-9_]*\s*\((.*)\)\z", 1), F.lit("")), text))
    return F.when(inner.startswith("'"), string_value(inner)).when(inner.rlike(r"\A\.[A-Z0-9_]+\.\z"), F.regexp_extract(inner, r"\A\.(.*)\.\z", 1)).when(~inner.isin("$", "*", ""), inner)


def list_items(text: Column) -> Column:
    """The items of a bracketed list, as written; commas within strings or inner brackets don't part them."""
    inner = F.regexp_extract(text, r"(?s)\A\((.*)\)\z", 1)
    item = r"(?s)((?:'(?:[^']|'')*'|\((?:'(?:[^']|'')*'|[^'()])*\)|[^',()])+)"
    return F.transform(F.regexp_extract_all(inner, F.lit(item), F.lit(1)), lambda x: F.trim(x))


def relation_ends(instances: DataFrame) -> DataFrame:
    """(package_id, path, id, original_class, relation_type, role, ref): each end of each relation with the attribute that names it.

    Relations whose class isn't known keep it in ``relation_type``; their ends are told by the place of their argument.
    """
    rel = instances.filter(F.col("original_class").startswith("IFCREL"))
    names = F.create_map(*[F.lit(x) for pair in IFC_RELATIONS.items() for x in pair])
    kind = F.coalesce(F.try_element_at(names, "original_class"), F.concat(F.lit("ifc:"), "original_class"))
    # the first two of a whole relation's arguments are its name and its owner
    placed = rel.select(*KEYS, "id", "original_class", kind.alias("relation_type"), F.size("args").alias("n"), F.posexplode("args").alias("place", "text")).filter("place > 1 or n <= 4")
    role = F.lit(None).cast("string")
    for name, ends in IFC_ENDS.items():
        for place, end in ends.items():
            role = F.when((F.col("original_class") == name) & (F.col("place") == place), end).otherwise(role)
    role = F.coalesce(role, F.concat(F.lit("argument-"), F.col("place").cast("string")))
    return placed.select(*KEYS, "id", "original_class", "relation_type", role.alias("role"), F.explode(references(F.col("text"))).alias("ref"))


def ifc_relations(instances: DataFrame) -> DataFrame:
    """(package_id, path, id, relation_type, ref): what each relation joins, each once; its owner isn't joined."""
    rel = instances.filter(F.col("original_class").startswith("IFCREL"))
    names = F.create_map(*[F.lit(x) for pair in IFC_RELATIONS.items() for x in pair])
    kind = F.coalesce(F.try_element_at(names, "original_class"), F.concat(F.lit("ifc:"), "original_class"))
    ends = F.when(F.size("args") <= 4, F.col("args")).otherwise(F.slice("args", F.lit(3), F.size("args")))
    return rel.select(*KEYS, "id", kind.alias("relation_type"), F.explode(F.array_distinct(F.flatten(F.transform(ends, references)))).alias("ref"))


def properties(instances: DataFrame) -> DataFrame:
    """(package_id, path, id, original_class, name, measure, values, unit): single, enumerated, listed and bounded values, and quantities.

    ``values`` are texts; a bounded value has its upper, lower and set value in this order, absent ones null. An explicit ``$`` is an array of
    one null. ``unit`` is the number of the unit's instance.
    """
    kind = F.col("original_class")
    rows = instances.filter(kind.isin(SINGLE, ENUMERATED, LISTED, BOUNDED) | kind.startswith("IFCQUANTITY"))
    several = kind.isin(ENUMERATED, LISTED)
    quantity = kind.startswith("IFCQUANTITY")
    items = F.when(several, list_items(argument(2))).when(kind == BOUNDED, F.array(argument(2), argument(3), argument(5))).when(quantity, F.array(argument(3))).otherwise(F.array(argument(2)))
    unit = F.when(kind.isin(SINGLE, LISTED), argument(3)).when(kind == BOUNDED, argument(4)).when(quantity, argument(2))
    read = rows.select(*KEYS, "id", "original_class", string_value(argument(0)).alias("name"), items.alias("items"), F.get(references(unit), 0).alias("unit"))
    return read.select(*KEYS, "id", "original_class", "name", measure(F.get(F.array_compact("items"), 0)).alias("measure"), F.transform("items", plain_value).alias("values"), "unit")


def ifc_properties(instances: DataFrame) -> DataFrame:
    """(package_id, path, id, name, value) of single values."""
    return properties(instances.filter(F.col("original_class") == SINGLE)).select(*KEYS, "id", "name", F.get("values", 0).alias("value"))


def property_sets(instances: DataFrame) -> DataFrame:
    """(package_id, path, set, set_name, prefix, property): the properties of sets and of element quantities, those of complex properties included.

    ``prefix`` is the dotted path of the complex properties above; beyond ``COMPLEX_DEPTH`` levels nothing is followed, so cycles end.
    """
    kind = F.col("original_class")
    held = F.when(kind == "IFCPROPERTYSET", argument(4)).otherwise(argument(5))
    sets = instances.filter(kind.isin("IFCPROPERTYSET", "IFCELEMENTQUANTITY"))
    now = sets.select(*KEYS, F.col("id").alias("set"), string_value(argument(2)).alias("set_name"), F.lit("").alias("prefix"), F.explode(references(held)).alias("property"))
    complexes = instances.filter(kind == "IFCCOMPLEXPROPERTY").select(*KEYS, F.col("id").alias("property"), string_value(argument(0)).alias("above"), references(argument(3)).alias("below"))
    out = now
    for _ in range(COMPLEX_DEPTH):
        inner = joined(now, complexes, [*KEYS, "property"])
        now = inner.select(*KEYS, "set", "set_name", F.concat("prefix", "above", F.lit(".")).alias("prefix"), F.explode("below").alias("property"))
        out = out.union(now)
    return out


def element_properties(instances: DataFrame) -> DataFrame:
    """(package_id, path, element, element_class, set_name, name, measure, values, unit, origin) of all elements.

    Sets reach an element by relations or through the type that it is defined by; where both give a property of one set, the
    element's own counts. ``origin`` tells which.
    """
    ends = relation_ends(instances.filter(F.col("original_class").isin("IFCRELDEFINESBYPROPERTIES", "IFCRELDEFINESBYTYPE")))
    side = lambda name, role, new: ends.filter(F.col("original_class") == name).filter(F.col("role") == role).select(*KEYS, "id", F.col("ref").alias(new))
    own = side("IFCRELDEFINESBYPROPERTIES", "RelatedObjects", "element")
    own = joined(own, side("IFCRELDEFINESBYPROPERTIES", "RelatingPropertyDefinition", "set"), [*KEYS, "id"])
    types = joined(side("IFCRELDEFINESBYTYPE", "RelatedObjects", "element"), side("IFCRELDEFINESBYTYPE", "RelatingType", "type"), [*KEYS, "id"])
    of_type = instances.filter(F.col("original_class").rlike("^IFC[A-Z0-9]*(TYPE|STYLE)$")).select(*KEYS, F.col("id").alias("type"), F.explode(references(argument(5))).alias("set"))
    inherited = joined(types, of_type, [*KEYS, "type"])
    given = own.select(*KEYS, "element", "set", F.lit(0).alias("rank")).union(inherited.select(*KEYS, "element", "set", F.lit(1).alias("rank"))).distinct()
    named = properties(instances).select(*KEYS, F.col("id").alias("property"), "name", "measure", "values", "unit")
    filled = joined(property_sets(instances), named, [*KEYS, "property"]).withColumn("name", F.concat("prefix", "name"))
    classes = instances.select(*KEYS, F.col("id").alias("element"), F.col("original_class").alias("element_class"))
    rows = joined(joined(given, filled, [*KEYS, "set"]), classes, [*KEYS, "element"])
    first = F.row_number().over(Window.partitionBy(*KEYS, "element", "set_name", "name").orderBy("rank", "set", "property"))
    kept = rows.withColumn("first", first).filter("first = 1")
    return kept.select(*KEYS, "element", "element_class", "set_name", "name", "measure", "values", "unit", F.when(F.col("rank") == 0, "occurrence").otherwise("type").alias("origin"))


# ---- files where they stand: the same rows without joins

_STRING = re.compile(r"'(?:[^']|'')*+'")
_REFERENCE = re.compile(r"#([1-9][0-9]*)")
_ESCAPED = re.compile(r"\\X2\\[0-9A-F]*\\X0\\|\\X\\[0-9A-F]{2}|\\S\\.|[^\\]+|\\", re.DOTALL)
_MEASURE = re.compile(r"([A-Z][A-Z0-9_]*)\s*\(", re.ASCII)
_MEASURED = re.compile(r"[A-Z][A-Z0-9_]*\s*\((.+)\)", re.DOTALL | re.ASCII)
_NAMED = re.compile(r"\.([A-Z0-9_]+)\.")
#: As in :func:`list_items`, but no part is tried in two ways, so many quotes take no longer than their number.
_ITEM = re.compile(r"(?:'(?:[^']|'')*+'|\((?:'(?:[^']|'')*+'|[^'()])*+\)|[^',()])+")
_TYPE = re.compile(r"IFC[A-Z0-9]*(?:TYPE|STYLE)")

#: An instance as :func:`scanners.scan_step` gives it, and a property as (name, measure, values, unit).
Instance = tuple[int, str, str, list[int], list[str] | None]
Property = tuple[str | None, str | None, list[str | None] | None, int | None]


def _argument(args: list[str], place: int) -> str | None:
    return args[place] if place < len(args) and args[place] not in ("$", "*") else None


def _references(text: str | None) -> list[int]:
    if not text or "#" not in text:
        return []
    return [int(x) for x in _REFERENCE.findall(_STRING.sub("", text))]


def _escape(x: str) -> str:
    if x.startswith("\\X2\\"):
        units = x[4:-4]
        # an escape with half a character must not end the scan of all files
        return bytes.fromhex("0" * (len(units) % 2) + units).decode("utf-16-be", "replace")
    if x.startswith("\\X\\"):
        return chr(int(x[3:5], 16))
    return chr((ord(x[3]) + 128) % 256) if x.startswith("\\S\\") else x


def _string_value(text: str | None) -> str | None:
    if not text or text[0] != "'":
        return None
    inner = text[1:-1].replace("''", "'")
    if "\\" not in inner:
        return inner
    return "".join(_escape(x) for x in _ESCAPED.findall(inner.replace("\\\\", "\x01"))).replace("\x01", "\\")


def _plain_value(text: str | None) -> str | None:
    if text is None:
        return None
    inner = (m[1] if (m := _MEASURED.fullmatch(text)) else text).strip(" ")
    if inner.startswith("'"):
        return _string_value(inner)
    if m := _NAMED.fullmatch(inner):
        return m[1]
    return None if inner in ("$", "*", "") else inner


def _list_items(text: str | None) -> list[str] | None:
    if text is None:
        return None
    return [x.strip(" ") for x in _ITEM.findall(text[1:-1])] if len(text) > 1 and text[0] == "(" and text[-1] == ")" else []


def _property(kind: str, args: list[str]) -> Property:
    """The property as :func:`properties` reads it."""
    at = lambda place: _argument(args, place)
    if kind in (ENUMERATED, LISTED):
        items = _list_items(at(2))
    elif kind == BOUNDED:
        items = [at(2), at(3), at(5)]
    else:
        items = [at(3 if kind.startswith("IFCQUANTITY") else 2)]
    unit = None if kind == ENUMERATED else at(4 if kind == BOUNDED else 3 if kind in (SINGLE, LISTED) else 2)
    first = next((x for x in items or [] if x is not None), None)
    found = _MEASURE.match(first) if first is not None else None
    return _string_value(at(0)), found and found[1], items and [_plain_value(x) for x in items], next(iter(_references(unit)), None)


def model_rows(found: list[Instance]) -> Iterator[tuple]:
    """(element, element_class, set_name, name, measure, values, unit, origin) of one file, as :func:`element_properties` tells them."""
    classes: dict[int, str] = {}
    arguments: dict[int, list[str]] = {}
    own: list[tuple[str, list[str]]] = []
    for k, kind, _, _, args in found:
        classes[k] = kind
        if args is not None:
            arguments[k] = args
            if kind in ("IFCRELDEFINESBYPROPERTIES", "IFCRELDEFINESBYTYPE"):
                own.append((kind, args))
    given: dict[int, set[tuple[int, int]]] = {}
    for kind, args in own:
        ends = _references(args[5]) if len(args) > 5 else []
        if kind == "IFCRELDEFINESBYPROPERTIES":
            sets = {(0, s) for s in ends}
        else:
            sets = {(1, s) for t in ends if t in arguments and _TYPE.fullmatch(classes[t]) for s in _references(_argument(arguments[t], 5))}
        for element in _references(args[4]) if sets else []:
            if element in classes:
                given.setdefault(element, set()).update(sets)
    read: dict[int, Property] = {}
    filled: dict[int, tuple[str | None, list[tuple]]] = {}

    def fill(s: int) -> tuple[str | None, list[tuple]]:
        kind = classes.get(s)
        if kind not in ("IFCPROPERTYSET", "IFCELEMENTQUANTITY"):
            return None, []
        now: set[tuple[str | None, int]] = {("", p) for p in _references(_argument(arguments[s], 4 if kind == "IFCPROPERTYSET" else 5))}
        reached = set(now)
        for _ in range(COMPLEX_DEPTH):
            below = set()
            for prefix, p in now:
                if classes.get(p) == "IFCCOMPLEXPROPERTY":
                    above = _string_value(_argument(arguments[p], 0))
                    prefix = None if prefix is None or above is None else f"{prefix}{above}."
                    below.update((prefix, q) for q in _references(_argument(arguments[p], 3)))
            now = below
            reached |= now
        rows = []
        for prefix, p in sorted(reached, key=lambda x: x[1]):
            kind = classes.get(p, "")
            if kind in (SINGLE, ENUMERATED, LISTED, BOUNDED) or kind.startswith("IFCQUANTITY"):
                if p not in read:
                    read[p] = _property(kind, arguments[p])
                name, *others = read[p]
                rows.append((None if prefix is None or name is None else prefix + name, *others))
        return _string_value(_argument(arguments[s], 2)), rows

    for element, sets in given.items():
        told = set()
        for rank, s in sorted(sets):
            if s not in filled:
                filled[s] = fill(s)
            set_name, rows = filled[s]
            for name, *others in rows:
                if (set_name, name) not in told:
                    told.add((set_name, name))
                    yield element, classes[element], set_name, name, *others, "type" if rank else "occurrence"


_ROW = pa.schema(
    [("package_id", pa.string()), ("path", pa.string()), ("element", pa.int64()), ("element_class", pa.string()), ("set_name", pa.string()), ("name", pa.string()), ("measure", pa.string()), ("values", pa.list_(pa.string())), ("unit", pa.int64()), ("origin", pa.string())]
)
_ROW_SQL = "package_id string, path string, element long, element_class string, set_name string, name string, measure string, values array<string>, unit long, origin string"


def _placed(rows: list[tuple], places: list[tuple[str, str, int, int]]) -> pa.RecordBatch:
    """The rows from first to last of each (package_id, path, first, last), in order."""
    packages, paths, first, last = zip(*places)
    first, n = np.array(first), np.array(last) - np.array(first)
    file = np.repeat(np.arange(len(places)), n)
    row = np.arange(len(file)) + np.repeat(first - np.cumsum(n) + n, n)
    keys = [pa.array(c, pa.string()).take(pa.array(file)) for c in (packages, paths)]
    return pa.RecordBatch.from_arrays([*keys, *(pa.array(c, f.type).take(pa.array(row)) for c, f in zip(zip(*rows), list(_ROW)[2:]))], schema=_ROW)


def _size(row: tuple) -> int:
    return 64 + sum(len(x) for x in (row[2], row[3], *(row[5] or ())) if x)


def file_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of files (package_id, path, content), in pieces; equal files are worked out once while their rows are kept."""
    rows: list[tuple] = []
    known: dict[bytes, tuple[int, int, int]] = {}
    places: list[tuple[str, str, int, int]] = []
    made = held = out = 0
    for batch in batches:
        for package, path, content in zip(*(batch.column(c).to_pylist() for c in ("package_id", "path", "content"))):
            span = known.get(content)
            if span is None:
                first, began, whole = len(rows), made, True
                try:
                    found = scan_step(content.decode("latin-1"))
                except ValueError:
                    found = []
                for row in model_rows(found):
                    rows.append(row)
                    made += _size(row)
                    if made - began >= BATCH_BYTES:
                        yield _placed(rows, [*places, (package, path, first, len(rows))])
                        rows, known, places, made, held, out = [], {}, [], 0, 0, 0
                        first, began, whole = 0, 0, False
                span = first, len(rows), made - began
                if whole:
                    known[content] = span
                    held += len(content)
            if span[1] > span[0]:
                places.append((package, path, *span[:2]))
                out += span[2]
            if out >= BATCH_BYTES or held >= BATCH_BYTES:
                if places:
                    yield _placed(rows, places)
                places, out = [], 0
                if made + held >= BATCH_BYTES:
                    rows, known, made, held = [], {}, 0, 0
    if places:
        yield _placed(rows, places)


def file_properties(files: DataFrame) -> DataFrame:
    """The rows of :func:`element_properties` straight from STEP files: each is parsed and its sets are filled where it stands, many in a batch.

    Nothing is grouped or joined, so files that share their keys stay apart. Files that don't parse have no rows; their errors are told by
    :func:`scanners.step_instances`.
    """
    return files.select("package_id", "path", "content").mapInArrow(file_rows, _ROW_SQL)
