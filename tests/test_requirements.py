import pytest

from trussline.operators import drawings
from trussline.sources.requirements import RequirementError, read_requirements

PROPERTY = '<property cardinality="{}"><propertySet><simpleValue>P</simpleValue></propertySet><baseName><simpleValue>{}</simpleValue></baseName>{}</property>'
RULE = '<value><xs:restriction base="xs:{}">{}</xs:restriction></value>'


def document(*properties, version="IFC4", entity="<entity><name><simpleValue>IFCWALL</simpleValue></name></entity>"):
    return f'<ids xmlns="http://standards.buildingsmart.org/IDS" xmlns:xs="http://www.w3.org/2001/XMLSchema"><specifications><specification name="walls" ifcVersion="{version}"><applicability>{entity}</applicability><requirements>{"".join(properties)}</requirements></specification></specifications></ids>'


def test_documents_become_requirements():
    one = '<xs:enumeration value="a"/><xs:enumeration value="b"/>'
    bounds = '<xs:minInclusive value="1.5"/><xs:maxExclusive value="3"/>'
    read = read_requirements(document(PROPERTY.format("required", "Fire", ""), PROPERTY.format("prohibited", "Old", "<value><simpleValue>x</simpleValue></value>"), PROPERTY.format("optional", "Kind", RULE.format("string", one)), PROPERTY.format("required", "Code", RULE.format("string", '<xs:pattern value="[A-Z]+"/>')), PROPERTY.format("required", "Width", RULE.format("double", bounds))))
    assert read.unsupported == ()
    assert [{k: v for k, v in e.items() if k not in ("name", "entity")} for e in read.entries] == [
        {"property": "Fire", "cardinality": "required"},
        {"property": "Old", "cardinality": "prohibited", "value": "x"},
        {"property": "Kind", "cardinality": "optional", "values": ["a", "b"]},
        {"property": "Code", "cardinality": "required", "pattern": "[A-Z]+"},
        {"property": "Width", "cardinality": "required", "minInclusive": 1.5, "maxExclusive": 3.0},
    ]


def test_what_is_beyond_the_check_is_told():
    read = read_requirements(document("<material/>", PROPERTY.format("twice", "A", ""), PROPERTY.format("required", "B", RULE.format("string", '<xs:length value="3"/>')), PROPERTY.format("required", "C", RULE.format("double", '<xs:minInclusive value="inf"/>')), version="IFC9"))
    at = "specification:0000"
    assert read.entries == ()
    assert read.unsupported == (("REQUIREMENT_CARDINALITY_UNSUPPORTED", f"{at}/requirement:0001"), ("REQUIREMENT_FACET_UNSUPPORTED", f"{at}/requirement:0000"), ("REQUIREMENT_RESTRICTION_UNSUPPORTED", f"{at}/requirement:0002"), ("REQUIREMENT_RESTRICTION_UNSUPPORTED", f"{at}/requirement:0003"), ("REQUIREMENT_VERSION_UNSUPPORTED", at))
    assert read_requirements(document(entity="<classification/>")).unsupported == (("REQUIREMENT_FACET_UNSUPPORTED", f"{at}/applicability"),)


@pytest.mark.parametrize(
    "text, code",
    [
        ("<ids", "REQUIREMENTS_INVALID"),
        ("<ids/>", "REQUIREMENTS_NAMESPACE"),
        ('<ids xmlns="http://standards.buildingsmart.org/IDS"/>', "REQUIREMENTS_INVALID"),
        ('<!DOCTYPE a [<!ENTITY b "c">]>' + document(), "REQUIREMENTS_ACTIVE_CONTENT"),
        (document("<property>" * 40 + "</property>" * 40), "REQUIREMENTS_TOO_LARGE"),
        (document(" " * (1 << 20)), "REQUIREMENTS_TOO_LARGE"),
    ],
)
def test_documents_that_are_refused(text, code):
    with pytest.raises(RequirementError, match=code):
        read_requirements(text)


def test_findings(spark):
    instances = spark.createDataFrame([("p", k, "IFCWALL") for k in range(1, 6)] + [("p", 9, "IFCDOOR")], "package_id string, id long, original_class string")
    rows = [("p", 1, "Width", "2"), ("p", 2, "Width", "3"), ("p", 3, "Width", "wide"), ("p", 4, "Kind", "c"), ("p", 5, "Kind", "a")]
    properties = spark.createDataFrame(rows, "package_id string, id long, name string, value string")
    check = lambda **r: {x.id: x.code for x in drawings.requirement_findings(instances, properties, [{"name": "n", "entity": "IFCWALL"} | r]).collect()}
    unmet = lambda *ids: dict.fromkeys(ids, "REQUIREMENT_UNMET")
    assert check(property="Width", minInclusive=1.5, maxExclusive=3.0) == unmet(2, 3, 4, 5)
    assert check(property="Width", minExclusive=2.0, cardinality="optional") == unmet(1, 3)
    assert check(property="Kind", values=["a", "b"], cardinality="optional") == unmet(4)
    assert check(property="Kind", values=["a", "b"], cardinality="prohibited") == {5: "REQUIREMENT_PROHIBITED"}
    assert drawings.requirement_findings(instances, properties, []).count() == 0
