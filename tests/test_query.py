import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from trussline.functions import canon
from trussline.operators import query

RECORDS = [
    ("a", "entity", {"v": 1, "n": {"x": None}}),
    ("b", "entity", {"v": 1.0, "n": {"x": "s"}}),
    ("c", "entity", {"v": True}),
    ("d", "entity", {"v": "1", "n": [1]}),
    ("e", "relation", {"v": [1, {"k": 1.0}], "n": {"x": {"y": 2}}}),
    ("f", "relation", {}),
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([(a, b, json.dumps(c)) for a, b, c in RECORDS], "record_id string, record_type string, json string")


def python_answer(expression):
    q = query.parse(expression)
    out = []
    for name, kind, value in RECORDS:
        for part in q.path:
            value = value[part] if isinstance(value, dict) and part in value else query
        if q.kind in ("record", kind) and (value is not query and value == q.literal) != q.negated:
            out.append(name)
    return out


@pytest.mark.parametrize(
    "expression",
    ["entity.v == 1", "record.v == true", "record.v != 1", "record.n.x == null", "record.n.x != null", 'entity.v == "1"', 'record.v == [true, {"k": 1}]', "record.n.x.y == 2", "record.n.x == {\"y\": 2.0}", "relation.missing != 0", "source.v == 1", "record.v == NaN", "record.n == [1.0]"],
)
def test_equality(records, expression):
    assert [r.record_id for r in query.run_query(records, expression).collect()] == python_answer(expression)


@pytest.mark.parametrize("bad", ["entity.v = 1", "entity.v == x", "thing.v == 1", "entity.a-b == 1", "entity.v == 1\n2", ""])
def test_syntax(bad):
    with pytest.raises(query.QuerySyntaxError):
        query.parse(bad)


JSON = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.floats(-2, 2) | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=2), x, max_size=3), max_leaves=6)


@given(JSON, JSON)
def test_equality_keys_agree_with_equality(a, b):
    assert (canon.key_of(json.dumps(a)) == canon.key_of(json.dumps(b))) == (a == b)


def test_canonical():
    assert canon.canonical('{"b":1,"a":"é"}') == '{"a":"é","b":1}'
    assert canon.canonical('{"é":1,"é":2}') is None
    assert canon.canonical("[" * 40 + "]" * 40) is None
    assert canon.canonical("NaN") is None and canon.canonical("{") is None


def test_plan_pushes_the_type(spark, records, tmp_path):
    records.write.parquet(str(tmp_path / "r"))
    plan = query.run_query(spark.read.parquet(str(tmp_path / "r")), 'entity.v == "1"')._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(record_type), EqualTo(record_type,entity)]" in plan
