import pytest

from tests.oracle import as_set, connect
from trussline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    assert as_set(queries.queries()[name](spark, sf).toPandas()) == as_set(connect(sf).execute(queries.oracle_sql()[name]).df())
