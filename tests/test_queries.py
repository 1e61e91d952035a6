import pytest
from oracle import compare, connect

import __spark_entry__
from tracelake.plans import catalog


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, small, duck, name):
    compare(catalog.QUERIES[name](spark, small), duck, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() >= 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["type", "date", "count"] and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
