"""Every registered query against its SQL, on whole tables."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from workload.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, sf, con, name):
    assert difference(entry.queries()[name](spark, sf), con, entry.oracle_sql()[name]) is None
