"""Every query that has SQL gives the same rows as DuckDB on the small tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle_check import DATA, compare, connect

SF = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert compare(got, duck.execute(entry.oracle_sql()[name]).df()) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
