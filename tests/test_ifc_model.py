import random

import pyarrow as pa
import pytest

from tests.test_scanners import files
from trussline.plans import catalog
from trussline.sources import ifc_model, scanners
from trussline.storage import stored


def model(spark, body):
    return scanners.step_instances(files(spark, a=f"ISO-10303-21;HEADER;ENDSEC;DATA;{body}ENDSEC;END-ISO-10303-21;"))


@pytest.mark.parametrize(
    "raw, args",
    [
        ("#1=A();", []),
        ("#1=A($);", ["$"]),
        ("#1=A('a, (b)',#2 , .T.);", ["'a, (b)'", "#2", ".T."]),
        ("#1=A('it''s',(1,(2,'x,)')),B('q'));", ["'it''s'", "(1,(2,'x,)'))", "B('q')"]),
        ("#1=A(1.5/* c, d */,*,'');", ["1.5", "*", "''"]),
    ],
)
def test_arguments(raw, args):
    assert scanners.step_arguments(raw) == args


def test_values(spark):
    cases = [
        ("'plain'", None, "plain"), ("'it''s, ok'", None, "it's, ok"), ("IFCLABEL('(x)')", "IFCLABEL", "(x)"), ("$", None, None), ("*", None, None), (".TRUE.", None, "TRUE"), ("IFCBOOLEAN(.F.)", "IFCBOOLEAN", "F"),
        ("-1.5E-3", None, "-1.5E-3"), ("IFCREAL(2.)", "IFCREAL", "2."), (r"'\X2\00E9306F\X0\ \X\E9\S\i\\ '", None, "éは éé\\ "), ("''", None, ""),
    ]
    rows = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, t string")
    got = rows.select("k", ifc_model.measure(rows.t).alias("m"), ifc_model.plain_value(rows.t).alias("v")).orderBy("k").collect()
    assert [(r.m, r.v) for r in got] == [c[1:] for c in cases]


def test_properties_of_every_kind(spark):
    m = model(
        spark,
        "#1=IFCPROPERTYSINGLEVALUE('N','d, e',$,$);#2=IFCPROPERTYSINGLEVALUE('A, b','',IFCTEXT('v, ''w'''),#9);#3=IFCPROPERTYENUMERATEDVALUE('E',$,(IFCLABEL('a, b'),IFCLABEL('c)')),$);"
        "#4=IFCPROPERTYLISTVALUE('L','x',(IFCREAL(1.),IFCREAL(2.)),#9);#5=IFCPROPERTYBOUNDEDVALUE('B',$,IFCREAL(3.),IFCREAL(1.),#9,$);#6=IFCQUANTITYLENGTH('Q','d',#9,4.5,$);",
    )
    got = {r.id: (r.name, r.measure, r["values"], r.unit) for r in ifc_model.properties(m).collect()}
    assert got == {
        1: ("N", None, [None], None),
        2: ("A, b", "IFCTEXT", ["v, 'w'"], 9),
        3: ("E", "IFCLABEL", ["a, b", "c)"], None),
        4: ("L", "IFCREAL", ["1.", "2."], 9),
        5: ("B", "IFCREAL", ["3.", "1.", None], 9),
        6: ("Q", None, ["4.5"], 9),
    }


def test_ends_have_roles(spark):
    m = model(spark, "#1=IFCRELAGGREGATES('g',#9,'n, #8',$,#2,(#3,#4));#5=IFCRELCONTAINEDINSPATIALSTRUCTURE('h',#9,$,$,(#3),#2);#6=IFCRELODD('i',#9,$,$,#7);")
    got = sorted((r.id, r.relation_type, r.role, r.ref) for r in ifc_model.relation_ends(m).collect())
    assert got == [(1, "aggregation", "RelatedObjects", 3), (1, "aggregation", "RelatedObjects", 4), (1, "aggregation", "RelatingObject", 2), (5, "containment", "RelatedElements", 3), (5, "containment", "RelatingStructure", 2), (6, "ifc:IFCRELODD", "argument-4", 7)]


def test_elements_inherit_from_their_type(spark):
    m = model(
        spark,
        "#1=IFCWALL('g',#9,$,$,$,$,$,$);#2=IFCDOOR('d',#9,$,$,$,$,$,$,$,$);#3=IFCWALLTYPE('t',#9,$,$,$,(#6),$,$,$,$);#4=IFCPROPERTYSINGLEVALUE('P',$,IFCLABEL('own'),$);#5=IFCPROPERTYSET('p',#9,'S',$,(#4));"
        "#6=IFCPROPERTYSET('q',#9,'S',$,(#7,#8));#7=IFCPROPERTYSINGLEVALUE('P',$,IFCLABEL('type'),$);#8=IFCCOMPLEXPROPERTY('C',$,'u',(#7,#8));#10=IFCRELDEFINESBYPROPERTIES('r',#9,$,$,(#1,#2),#5);#11=IFCRELDEFINESBYTYPE('s',#9,$,$,(#1),#3);"
        "#12=IFCELEMENTQUANTITY('e',#9,'Q',$,$,(#13));#13=IFCQUANTITYAREA('A',$,$,2.,$);#14=IFCRELDEFINESBYPROPERTIES('r2',#9,$,$,(#2),#12);",
    )
    got = {(r.element, r.element_class, r.set_name, r.name): (r["values"], r.origin) for r in ifc_model.element_properties(m).collect()}
    assert got[1, "IFCWALL", "S", "P"] == (["own"], "occurrence")
    assert got[1, "IFCWALL", "S", "C.P"] == (["type"], "type") and got[2, "IFCDOOR", "S", "P"] == (["own"], "occurrence") and got[2, "IFCDOOR", "Q", "A"] == (["2."], "occurrence")
    assert not any(k[0] == 2 and k[3].startswith("C.") for k in got)


def test_models_are_never_sent_through_the_driver(spark):
    plan = ifc_model.element_properties(model(spark, "#1=IFCWALL('g');"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


ONE_SET = "#1=IFCWALL('g');#2=IFCPROPERTYSINGLEVALUE('P',$,IFCLABEL('own'),$);#3=IFCPROPERTYSINGLEVALUE('Q',$,$,$);#4=IFCPROPERTYSET('p',$,'S',$,(#2,#3));#5=IFCRELDEFINESBYPROPERTIES('r',$,$,$,(#1),#4);"


def random_model(r):
    """A model whose elements, types, sets and properties refer to each other, and to instances that aren't there or are of another kind."""
    ref = lambda lo, hi: f"#{r.randint(1, 45) if r.random() < 0.1 else r.randint(lo, hi)}"
    refs = lambda lo, hi: r.choice(["$", "()", ref(lo, hi), *[f"({','.join(ref(lo, hi) for _ in range(r.randint(1, 4)))})"] * 5])
    text = lambda: r.choice(["$", "'A'", "'B'", "'b, (c)'", "'it''s'", r"'\X2\00E9306F\X0\ \X\E9\S\i\\ '", "''", "*", "'#5'"])
    value = lambda: r.choice(["$", "*", "IFCLABEL('x, ''y''')", "IFCREAL(2.)", ".TRUE.", "1.5", "IFCBOOLEAN(.F.)", "IFCLABEL()", "IFCLABEL($)", "'s'", "IFC (' a ')", ""])
    values = lambda: r.choice(["$", "()", "1.", f"({','.join(value() for _ in range(r.randint(1, 3)))})", "((1,2),(3,(4)))"])
    unit = lambda: r.choice(["$", "#44", "(#43,#44)"])
    elements, types, sets, properties, relations = (1, 4), (5, 8), (9, 14), (15, 30), (31, 42)
    kinds = {
        elements: {"IFCWALL": lambda: ["'g'", ref(*sets)], "IFCDOOR": lambda: []},
        types: {k: lambda: ["'t'", "$", "$", "$", "$", refs(*sets), "$"] for k in ("IFCWALLTYPE", "IFCDOORSTYLE", "IFCODD_TYPE")},
        sets: {"IFCPROPERTYSET": lambda: ["'p'", "$", text(), "$", refs(*properties)], "IFCELEMENTQUANTITY": lambda: ["'e'", "$", text(), "$", "$", refs(*properties)]},
        properties: {
            "IFCCOMPLEXPROPERTY": lambda: [text(), "$", "'u'", refs(*properties)],
            "IFCPROPERTYSINGLEVALUE": lambda: [text(), "$", value(), unit()],
            "IFCPROPERTYENUMERATEDVALUE": lambda: [text(), "$", values(), unit()],
            "IFCPROPERTYLISTVALUE": lambda: [text(), "$", values(), unit()],
            "IFCPROPERTYBOUNDEDVALUE": lambda: [text(), "$", value(), value(), unit(), value()],
            "IFCQUANTITYAREA": lambda: [text(), "$", unit(), value(), "$"],
        },
        relations: {"IFCRELDEFINESBYPROPERTIES": lambda: ["'r'", "$", "$", "$", refs(*elements), refs(*sets)], "IFCRELDEFINESBYTYPE": lambda: ["'r'", "$", "$", "$", refs(*elements), refs(*types)]},
    }
    body = ""
    for (lo, hi), made in kinds.items():
        for k in range(lo, hi + 1):
            kind = r.choice(list(made))
            args = made[kind]()[: r.choice([99] * 9 + [4])]
            body += "" if r.random() < 0.1 else f"#{k}=(IFCWALL($)IFCODD('x'));" if r.random() < 0.03 else f"#{k}={kind}({','.join(args)});"
    return f"ISO-10303-21;HEADER;ENDSEC;DATA;{body}ENDSEC;END-ISO-10303-21;"


def test_files_give_the_rows_of_their_instances(spark):
    r = random.Random(4)
    texts = {f"m{k}": random_model(r) for k in range(150)}
    given = files(spark, **texts, twice=texts["m3"], broken="ISO-10303-21;", none="").cache()
    plain = lambda rows: sorted((repr(tuple(row)) for row in rows.collect()))
    want = plain(ifc_model.element_properties(stored(scanners.step_instances(given), "models")))
    got = plain(ifc_model.file_properties(given))
    assert got == want and len(got) > 1000 and any("'type'" in x for x in got) and any("'A.B" in x for x in got)


def test_files_are_filled_where_they_stand(spark, sf):
    found = catalog.QUERIES["model_properties"](spark, sf)
    assert "Join" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and plan.count("Exchange") == 1
    same = files(spark, a=f"ISO-10303-21;HEADER;ENDSEC;DATA;{ONE_SET}ENDSEC;END-ISO-10303-21;")
    assert ifc_model.file_properties(same.union(same)).count() == 4


def test_files_are_handed_over_in_pieces(monkeypatch):
    r = random.Random(7)
    texts = [random_model(r) for _ in range(20)]
    order = [r.choice(texts) for _ in range(200)]
    batch = pa.RecordBatch.from_pydict({"package_id": [str(k) for k in range(200)], "path": ["f"] * 200, "content": [t.encode() for t in order]})
    want = pa.Table.from_batches(ifc_model.file_rows([batch])).to_pylist()
    assert {row["package_id"] for row in want} == {str(k) for k, t in enumerate(order) if list(ifc_model.model_rows(scanners.scan_step(t)))}
    for size in (1, 200, 1000, 5000):
        monkeypatch.setattr(ifc_model, "BATCH_BYTES", size)
        pieces = list(ifc_model.file_rows([batch.slice(0, 90), batch.slice(90)]))
        assert pa.Table.from_batches(pieces).to_pylist() == want and len(pieces) > 1


def test_half_a_character_does_not_end_the_scan():
    body = ONE_SET.replace("own", r"\X2\D83D\X0\x\X2\41\X0\ \X2\D83DDE00\X0" + "\\")
    found = list(ifc_model.model_rows(scanners.scan_step(f"ISO-10303-21;HEADER;ENDSEC;DATA;{body}ENDSEC;END-ISO-10303-21;")))
    assert found[0][5] == ["\ufffdx\ufffd \U0001f600"]


def test_statements_take_no_longer_than_their_length():
    run = ",".join(["0.25"] * 40)
    body = f"#1=IFCMATERIALLAYER({run},'n''',(({run},('x')),$));"
    (found,) = scanners.scan_step(f"ISO-10303-21;HEADER;ENDSEC;DATA;{body}ENDSEC;END-ISO-10303-21;")
    assert found[2] == body and found[4] == [*["0.25"] * 40, "'n'''", f"(({run},('x')),$)"]
    quotes = "'" + "''" * 40 + "'"
    assert ifc_model._list_items(f"({quotes},(1,{quotes}))") == [quotes, f"(1,{quotes})"] and ifc_model._list_items(f"(1,({quotes},(2)))")


def test_items_of_lists_are_whole(spark):
    rows = spark.createDataFrame([("(0.5, 1.5 ,22, '3' )",), ("($,1.,IFCREAL(2.))",)], "t string")
    assert [r.x for r in rows.select(ifc_model.list_items(rows.t).alias("x")).collect()] == [["0.5", "1.5", "22", "'3'"], ["$", "1.", "IFCREAL(2.)"]]
