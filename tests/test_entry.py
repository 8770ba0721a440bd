"""Every named query gives the rows of its SQL; those without SQL at least run."""

import pytest
from compare import compare, connect
from conftest import SF

import __spark_entry__ as contract
from lakekit.bindings import all_queries

SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_names():
    assert set(SQL) <= set(contract.queries())
    assert set(all_queries()) <= set(contract.queries())


def test_flagship(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(all_queries()))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    if name in SQL:
        assert compare(df, duck, SQL[name]) is None
    else:
        assert df.count() > 0
