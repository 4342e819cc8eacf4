"""Every named query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as E
from check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query(spark, con, name):
    message, *_ = compare(spark, con, SF, name)
    assert message is None, message


def test_entry_has_rows(spark):
    assert E.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
