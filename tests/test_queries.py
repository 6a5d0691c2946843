import pytest

from conftest import SMALL
from oracle_check import connect, differences

from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    assert differences(queries()[name](spark, SMALL), oracle_sql()[name], duck) == ""


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_runs(spark, name):
    assert queries()[name](spark, SMALL).count() > 0
