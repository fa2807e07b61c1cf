"""Every query with a SQL twin gives the twin's rows."""

import pytest

import __spark_entry__ as contract
from tools.check import compare, duck

TWINS = contract.oracle_sql()
QUERIES = contract.queries()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, con, sf, name):
    assert compare(spark, con, name, QUERIES[name], TWINS[name], sf) == ""


def test_entry(spark):
    row = contract.entry(spark).first()
    assert (row["lapses"], row["followed_by_lapse"]) == (104, 46)
