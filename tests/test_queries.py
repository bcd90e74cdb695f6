"""Every registered query of the fibre engine against its SQL, or by rows where SQL can't express it."""

import pytest

from fiberlake.plans.registry import ORACLES, QUERIES
from tests.compare import connection, rows_of


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, con, name):
    columns, got, want = rows_of(spark, sf, con, QUERIES[name], ORACLES[name])
    assert len(got) == len(want) and want
    assert got == want, (columns, sorted(set(got) - set(want), key=repr)[:3], sorted(set(want) - set(got), key=repr)[:3])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 7
    assert set(e.oracle_sql()) <= set(e.queries())
