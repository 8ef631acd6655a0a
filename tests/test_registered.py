"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points
from oracle import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

QUERIES = entry_points.queries()
SQL = entry_points.oracle_sql()
OWN = sorted(name for module in entry_points._MODULES for name, _, _ in module.QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = connect(SF_DIR)
    yield con
    con.close()


@pytest.fixture(scope="module")
def larger():
    con = connect("/root/testdata/sf0.01")
    yield con
    con.close()


def test_every_query_has_sql():
    assert set(OWN) <= set(SQL)


def test_names_are_unique():
    names = [name for module in entry_points._MODULES for name, _, _ in module.QUERIES]
    assert len(names) == len(set(names))


@pytest.mark.parametrize("name", OWN)
def test_finds_something(name, larger):
    """A result without rows would prove nothing."""
    assert larger.execute(SQL[name]).fetchall()


@pytest.mark.parametrize("name", OWN)
def test_matches_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SF_DIR), duck, SQL[name]) is None
