"""Every registered query with an SQL twin gives the twin's result."""

import pytest

import __spark_entry__ as entry
from tests.compare import check, duck

SF = entry.SMOKE_DIR


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    _, problem, _ = check(spark, con, name, SF)
    assert problem is None


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
