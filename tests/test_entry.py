import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_flagship(spark):
    assert entry.entry(spark).count() == 7


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    result = compare(spark, duck, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert result.startswith("ok"), result
    assert "TYPES" not in result, result
