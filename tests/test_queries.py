import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import difference, open_tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return open_tables(FOLDER)


@pytest.mark.parametrize("name", sorted(n for n in oracle_sql() if not n.startswith("op")))
def test_query_equals_its_sql(spark, tables, name):
    assert difference(queries()[name](spark, FOLDER), tables, oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(n for n in set(queries()) - set(oracle_sql()) if not n.startswith("op") and n != "pipeline"))
def test_query_without_sql_has_rows(spark, name):
    assert queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and df.columns[0] == "c_mktsegment"


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
