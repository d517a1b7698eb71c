import random

import pytest

from trussline.sources import ifc_model, scanners

STEP = """ISO-10303-21;
HEADER;
FILE_DESCRIPTION((''),'2;1');
FILE_SCHEMA(('IFC4'));
ENDSEC;
DATA;
#1=IFCPROJECT('g',$,'it''s; #9',$,(#2));
/* a ; comment #8 */ #2 = IFCWALL('w',#1,
 $);
#3=(NAMED_UNIT(#1)SI_UNIT(.M.));
#4=IFCRELAGGREGATES('r',$,#1,(#2));
#5=IFCPROPERTYSINGLEVALUE('Fire rating',$,IFCLABEL('F''30'),$);
#6=IFCRELODD('r',#7);
ENDSEC;
END-ISO-10303-21;
"""


def files(spark, **content):
    return spark.createDataFrame([("p", name, bytearray(x if isinstance(x, bytes) else x.encode())) for name, x in content.items()], "package_id string, path string, content binary")


def test_detect(spark):
    iges = "text".ljust(72) + "S      1\n"
    kinds = {"ifc": STEP, "step-iges": STEP.replace("IFC", "AP2"), "dwg": b"AC1032\0", "dxf": "0\nSECTION\n2\nHEADER\n", "pdf": "%PDF-1.7", "geometry": "v 0 0 0\nf 1 1 1\n", "image": "P5 2 2 255 abcd", "opaque": b"\x00\xff"}
    kinds |= {"step-iges2": iges, "geometry2": '{"asset":{"version":"2.0"}}', "geometry3": "solid x\nfacet", "image2": b"\x89PNG\r\n\x1a\n"}
    got = {r.path: r.kind for r in scanners.register_opaque(files(spark, **kinds)).collect()}
    assert got == {k: k.rstrip("23") for k in kinds}


def test_step(spark):
    rows = scanners.step_instances(files(spark, good=STEP, bad=STEP.replace("(#2));", "(#2);"), twice=STEP.replace("#2 =", "#1 =")))
    got = {r.id: (r.original_class, list(r.refs)) for r in rows.filter("path = 'good'").collect()}
    assert got == {1: ("IFCPROJECT", [2]), 2: ("IFCWALL", [1]), 3: ("COMPLEX_INSTANCE", [1]), 4: ("IFCRELAGGREGATES", [1, 2]), 5: ("IFCPROPERTYSINGLEVALUE", []), 6: ("IFCRELODD", [7])}
    assert {r.path: r.error for r in rows.filter("error is not null").collect()} == {"bad": "STEP_PARSE_FAILED", "twice": "STEP_ENTITY_DUPLICATE"}
    assert [r.ref for r in scanners.dangling_instances(rows.filter("error is null")).collect()] == [7]
    assert sorted((r.relation_type, r.ref) for r in ifc_model.ifc_relations(rows).collect()) == [("aggregation", 1), ("aggregation", 2), ("ifc:IFCRELODD", 7)]
    assert [(r.name, r.value) for r in ifc_model.ifc_properties(rows).collect()] == [("Fire rating", "F'30")]


def test_iges(spark):
    card = lambda text, kind, n: text.ljust(72) + kind + str(n).rjust(7)
    num = lambda *v: "".join(str(x).rjust(8) for x in v)
    text = "\n".join([card("x", "S", 1), card("1H,", "G", 1), card(num(110, 1, 0, 0, 3), "D", 1), card(num(110, 0, 0, 1, 2) + " " * 16 + "LINE".ljust(8), "D", 2), card(num(416, 2), "D", 3), card(num(416), "D", 4), card("110,0;", "P", 1), card("S1", "T", 1)])
    got = [(r.sequence, r.entity_type, r.level, r.form, r.label, r.is_external, r.is_paired) for r in scanners.iges_directory(files(spark, a=text)).orderBy("sequence").collect()]
    assert got == [(1, 110, 3, 2, "LINE", False, True), (3, 416, 0, 0, "", True, True)]


def test_dxf(spark):
    tags = "0 SECTION 2 HEADER 9 $INSUNITS 70 4 0 ENDSEC 0 SECTION 2 ENTITIES 0 LINE 5 1A 8 walls 10 1.5 20 2 11 3 21 4 0 TEXT 5 1B 8 notes 0 INSERT 5 1C 2 door 10 0 0 ENDSEC 0 EOF".split()
    got = scanners.dxf_entities(scanners.dxf_tags(files(spark, a="\n".join(tags)))).orderBy("nth").collect()
    assert [(r.type, r.handle, r.layer, r.block, r.kind) for r in got] == [("LINE", "1A", "walls", None, "linear-element"), ("TEXT", "1B", "notes", None, "annotation"), ("INSERT", "1C", None, "door", "opaque-object")]
    assert got[0].numbers == {10: 1.5, 20: 2.0, 11: 3.0, 21: 4.0}


def test_meshes(spark):
    obj = "# mesh\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 4/4\nf -4 -3 -2\n"
    v, f = scanners.obj_mesh(files(spark, a=obj))
    assert [(r.vertex, r.x, r.y) for r in v.orderBy("vertex").collect()] == [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 1.0), (3, 0.0, 1.0)]
    assert sorted((r.a, r.b, r.c) for r in f.collect()) == [(0, 1, 2), (0, 1, 2), (0, 2, 3)]
    stl = "solid a\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1e0 0\nendloop\nendfacet\nendsolid"
    assert [(r.vertex, r.x, r.y) for r in scanners.stl_triangles(files(spark, a=stl)).orderBy("vertex").collect()] == [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 1.0)]
    docs = {"a": '{"asset":{"version":"2.0"},"meshes":[{},{}],"buffers":[{"uri":"data:,"}]}', "b": '{"asset":{"version":"2.0"},"buffers":[{"uri":"x.bin"}]}', "c": '{"asset":{"version":"1.0"}}', "d": "{"}
    assert {r.path: (r.n_meshes, r.error) for r in scanners.gltf_summary(files(spark, **docs)).collect()} == {"a": (2, None), "b": (0, "MESH_EXTERNAL_RESOURCE"), "c": (0, "MESH_VERSION_UNSUPPORTED"), "d": (0, "MESH_PARSE_FAILED")}


def test_rasters(spark):
    png = b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4, "big") + b"IHDR" + (300).to_bytes(4, "big") + (20).to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
    got = {r.path: (r.format, r.width, r.height, r.depth, r.error) for r in scanners.raster_headers(files(spark, a=png, b="P2\n# c\n3 2\n255\n0 1 2 3 4 5\n", c="x", d="P5 20000 20000 65535 ")).collect()}
    assert got == {"a": ("PNG", 300, 20, 8, None), "b": ("PGM", 3, 2, 8, None), "c": (None, None, None, 8, "IMAGE_FORMAT_UNSUPPORTED"), "d": ("PGM", 20000, 20000, 16, "IMAGE_TOO_LARGE")}


def test_bundles(spark):
    entries = spark.createDataFrame([("p", "a", "root", 1, "x"), ("p", "b", "xref", 2, "y"), ("q", "a", "xref", 1, "x")], "package_id string, path string, role string, bytes long, sha256 string")
    there = spark.createDataFrame([("p", "a", 1, "x"), ("p", "b", 2, "z"), ("p", "c", 1, "x")], "package_id string, path string, bytes long, sha256 string")
    assert sorted(map(tuple, scanners.check_bundles(entries, there).collect())) == [("p", "BUNDLE_ENTRY_MISMATCH", "b"), ("p", "BUNDLE_FILE_UNLISTED", "c"), ("q", "BUNDLE_ENTRY_MISSING", "a"), ("q", "BUNDLE_ROOT_INVALID", "")]


def test_strict_json():
    assert scanners.strict_json('{"a": [1]}') == {"a": [1]}
    for bad in ('{"a":1,"a":2}', "[NaN]", "[Infinity]", "{"):
        with pytest.raises(ValueError):
            scanners.strict_json(bad)


def test_statements_survive_any_cut():
    r = random.Random(3)
    body = STEP[STEP.index("DATA;") + 5 : STEP.index("ENDSEC;", STEP.index("DATA;"))]
    assert len(list(scanners.step_statements(body))) == 6
    for _ in range(200):
        cut = body[: r.randrange(len(body))]
        try:
            assert len(list(scanners.step_statements(cut))) <= 6
        except ValueError:
            pass


def test_drawing_entities_equal_those_of_the_tags(spark):
    tags = "0 SECTION 2 HEADER 9 $INSUNITS 70 4 0 ENDSEC 0 SECTION 2 BLOCKS 0 LINE 5 9 10 x 20 1 0 ENDSEC 0 SECTION 2 ENTITIES 0 LINE 5 1A 8 walls 10 1.5 20 2 11 3 21 4 10 7 0 TEXT 5 1B 8 notes 999 y 0 INSERT 5 1C 2 door 10 0 0 ENDSEC 0 EOF".split()
    some = files(spark, a="\n".join(tags), b="7\nx\n0\nSECTION\n2\nENTITIES\n0\nCIRCLE\n40\n2\n5", c="1", d="x\ny")
    rows = lambda found: sorted(map(repr, found.select(*columns).collect()))
    columns = ["package_id", "path", "nth", "type", "section", "handle", "layer", "block", "kind", "numbers", "series"]
    got = rows(scanners.drawing_entities(some))
    assert len(got) == 5 and got == rows(scanners.dxf_entities(scanners.dxf_tags(some)))


def test_drawing_planes_deal_out_files_only(spark, sf):
    from trussline.plans import catalog

    plan = catalog.drawing_planes(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and "Join" not in plan


def test_plain_statements_read_as_all_others():
    text = "#1=A(1,(2,3),$);#2 = B ( ) ;#3=C('x;(',#1);/* c */#4=D((1.,2.),((3.)));#5=E(A(1));"
    found = [s for s, _ in scanners.step_statements(text)]
    assert found == ["#1=A(1,(2,3),$);", "#2 = B ( ) ;", "#3=C('x;(',#1);", "/* c */#4=D((1.,2.),((3.)));", "#5=E(A(1));"]
    assert [scanners.step_arguments(s) for s in found] == [["1", "(2,3)", "$"], [], ["'x;('", "#1"], ["(1.,2.)", "((3.))"], ["A(1)"]]
    for bad in ("#1=A(1;", "#1=A(1));", "#1=A(1);x"):
        with pytest.raises(ValueError):
            list(scanners.step_statements(bad))


def test_the_scan_tells_references_that_lack_their_instance(spark):
    rows = scanners.step_instances(files(spark, good=STEP)).cache()
    pairs = lambda found: sorted((r.id, r.ref) for r in found.collect())
    assert pairs(scanners.dangling_instances(rows)) == pairs(scanners.dangling_instances(rows.drop("lacking"))) == [(6, 7)]
    assert "Join" not in scanners.dangling_instances(rows)._jdf.queryExecution().executedPlan().toString()
