import pytest
from oracles import connection, spark_rows, sql_rows

from assetgraph.plans.registry import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf, con, name):
    names, rows = spark_rows(QUERIES[name](spark, sf))
    if name in ORACLE:
        assert (names, rows) == sql_rows(con, ORACLE[name])
    else:
        assert rows


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "label", "name", "depth"] and df.count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE) <= set(__spark_entry__.oracle_sql())
