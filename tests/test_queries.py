"""Every query against its SQL twin on the smallest tables; the rest must give rows."""

import pytest

import checks
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"
checks.load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(checks.ORACLES))
def test_query_matches_sql(spark, con, name):
    assert difference(checks.QUERIES[name](spark, SF), con, checks.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(checks.QUERIES) - set(checks.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert checks.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() == 9
