import math

import pytest

from tests.test_ifc_model import model
from trussline.sources import ifc_plane

BASE = "#1=IFCCARTESIANPOINT((1.,2.));#2=IFCCARTESIANPOINT((4.,2.));#3=IFCDIRECTION((0.,1.));#4=IFCAXIS2PLACEMENT2D(#1,$);#5=IFCAXIS2PLACEMENT2D(#1,#3);#6=IFCCIRCLE(#4,2.);#7=IFCELLIPSE(#5,3.,1.);#8=IFCPOLYLINE((#1,#2));"


def items(spark, body):
    return {r.id: r for r in ifc_plane.plane_geometry(model(spark, BASE + body)).collect()}


def near(path, points):
    return len(path) == len(points) and all(math.dist(p, q) < 1e-9 for p, q in zip(path, points))


def test_curves_of_every_kind(spark):
    got = items(
        spark,
        "#10=IFCTRIMMEDCURVE(#6,(IFCPARAMETERVALUE(0.)),(IFCPARAMETERVALUE(1.5707963267948966)),.T.,.PARAMETER.);#11=IFCTRIMMEDCURVE(#6,(IFCPARAMETERVALUE(0.)),(IFCPARAMETERVALUE(1.5707963267948966)),.F.,.PARAMETER.);"
        "#12=IFCCOMPOSITECURVESEGMENT(.CONTINUOUS.,.F.,#10);#13=IFCCOMPOSITECURVE((#12,#14),.U.);#14=IFCCOMPOSITECURVESEGMENT(.CONTINUOUS.,.T.,#8);"
        "#15=IFCCARTESIANPOINTLIST2D(((0.,0.),(1.,1.),(2.,0.),(5.,0.)));#16=IFCINDEXEDPOLYCURVE(#15,(IFCARCINDEX((1,2,3)),IFCLINEINDEX((3,4))),.F.);#17=IFCINDEXEDPOLYCURVE(#15,$,$);"
        "#18=IFCANNOTATIONFILLAREA(#6,(#8));#19=IFCTEXTLITERAL('a, (b)',#4,.RIGHT.);#20=IFCGEOMETRICCURVESET((#8,#6));",
    )
    assert all(r.reason is None for r in got.values())
    circle = got[6].paths[0]
    assert got[6].kind == "circle" and len(circle) == 65 and all(abs(math.dist(p, (1, 2)) - 2) < 1e-9 for p in circle) and near(circle[:1], [(3, 2)])
    assert near([got[7].paths[0][0], got[7].paths[0][16]], [(1, 5), (0, 2)])
    assert near([got[10].paths[0][0], got[10].paths[0][-1]], [(3, 2), (1, 4)]) and len(got[10].paths[0]) == 17
    assert near([got[11].paths[0][0], got[11].paths[0][-1]], [(1, 4), (3, 2)]) and len(got[11].paths[0]) == 49
    assert near(got[13].paths[0], got[10].paths[0][::-1]) and near(got[13].paths[1], [(1, 2), (4, 2)])
    arc, line = got[16].paths
    assert near([arc[0], arc[len(arc) // 2], arc[-1]], [(0, 0), (1, 1), (2, 0)]) and all(abs(math.dist(p, (1, 0)) - 1) < 1e-9 for p in arc) and near(line, [(2, 0), (5, 0)])
    assert near(got[17].paths[0], [(0, 0), (1, 1), (2, 0), (5, 0)])
    assert [len(p) for p in got[18].paths] == [65, 2] and got[19].paths == [] and [len(p) for p in got[20].paths] == [65, 2]


def test_mapped_items_move_and_turn(spark):
    got = items(
        spark,
        "#30=IFCSHAPEREPRESENTATION(#99,'Plan','Curve2D',(#8));#31=IFCREPRESENTATIONMAP(#4,#30);#32=IFCCARTESIANTRANSFORMATIONOPERATOR2D(#3,$,#2,2.);#33=IFCMAPPEDITEM(#31,#32);"
        "#34=IFCSHAPEREPRESENTATION(#99,'Plan','MappedRepresentation',(#33));#35=IFCREPRESENTATIONMAP(#4,#34);#36=IFCCARTESIANTRANSFORMATIONOPERATOR2DNONUNIFORM($,$,#1,1.,3.);#37=IFCMAPPEDITEM(#35,#36);",
    )
    assert near(got[33].paths[0], [(4, 2), (4, 8)])
    assert near(got[37].paths[0], [(4, 2), (4, 20)])


@pytest.mark.parametrize(
    "body, id, reason",
    [
        ("#10=IFCCOMPOSITECURVESEGMENT(.C.,.T.,#11);#11=IFCCOMPOSITECURVE((#10),.U.);", 11, ifc_plane.CYCLE),
        ("#10=IFCCIRCLE(#4,0.);", 10, ifc_plane.FAILED),
        ("#10=IFCCIRCLE(#77,1.);#11=IFCGEOMETRICCURVESET((#10));", 11, ifc_plane.FAILED),
        ("#10=IFCTRIMMEDCURVE(#6,(#1),(IFCPARAMETERVALUE(1.)),.T.,.CARTESIAN.);", 10, ifc_plane.FAILED),
        ("#10=IFCPOLYLINE((#1));", 10, ifc_plane.FAILED),
        ("#10=IFCTEXTLITERAL('" + "x" * 65_537 + "',#4,.LEFT.);", 10, ifc_plane.TEXT_LIMIT),
        ("#10=IFCCARTESIANPOINTLIST2D(((0.,0.),(1.,1.),(2.,2.)));#11=IFCINDEXEDPOLYCURVE(#10,(IFCARCINDEX((1,2,3))),$);", 11, ifc_plane.FAILED),
        ("".join(f"#{k}=IFCGEOMETRICCURVESET((#{k - 1 if k > 100 else 8}));" for k in range(100, 140)), 139, ifc_plane.TOO_DEEP),
    ],
)
def test_reasons(spark, body, id, reason):
    r = items(spark, body)[id]
    assert (r.paths, r.reason) == (None, reason)


def test_shared_parts_are_worked_out_once():
    rows = [(1, "IFCCARTESIANPOINT", ["(0.,0.)"], []), (2, "IFCCARTESIANPOINT", ["(1.,0.)"], []), (3, "IFCPOLYLINE", ["(#1,#2)"], [1, 2])]
    rows += [(k, "IFCGEOMETRICCURVESET", [f"(#{k - 1},#{k - 1})"], [k - 1]) for k in range(4, 30)]
    got = ifc_plane.evaluate(rows)
    assert got[18][2] is None and len(got[18][1]) == 2**15 and got[29][2] == ifc_plane.TOO_MANY


def test_geometry_of_files_equals_that_of_their_instances(spark):
    from tests.test_scanners import files
    from trussline.sources import scanners

    text = "ISO-10303-21;HEADER;ENDSEC;DATA;" + BASE + "#10=IFCTEXTLITERAL('a, (b)',#4,.RIGHT.);#11=IFCPOLYLINE((#1,#77));#12=IFCWALL(#1);ENDSEC;END-ISO-10303-21;"
    some = files(spark, a=text, b=text.replace("2.", "3."), bad=text.replace("#3=", "#2="), empty="ISO-10303-21;HEADER;ENDSEC;DATA;#1=IFCWALL('x');ENDSEC;END-ISO-10303-21;")
    rows = lambda found: sorted(map(repr, found.collect()))
    got = rows(ifc_plane.file_geometry(some))
    assert len(got) == 10 and got == rows(ifc_plane.plane_geometry(scanners.step_instances(some)))
