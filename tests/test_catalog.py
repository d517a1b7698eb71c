import pytest

from tests.oracle import as_set, connect
from trussline.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    assert as_set(catalog.QUERIES[name](spark, sf).toPandas()) == as_set(duck.execute(catalog.ORACLES[name]).df())


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
