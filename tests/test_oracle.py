"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from lumenframe.plans.registry import QUERIES, SQL

from .oracle import connect, difference

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, SMALL), entry.oracle_sql()[name], con) == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
