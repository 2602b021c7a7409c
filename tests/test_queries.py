"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_point
from insolara.plans import PLANS
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", [n for n, p in PLANS.items() if p.sql])
def test_query_equals_sql(spark, sf_dir, con, name):
    problem = compare(PLANS[name].build(spark, sf_dir), con, PLANS[name].sql)
    # the smallest tables may leave a filter without rows, on both sides alike
    assert problem in (None, "no rows"), problem


@pytest.mark.parametrize("name", [n for n, p in PLANS.items() if not p.sql])
def test_query_gives_rows(spark, sf_dir, name):
    assert PLANS[name].build(spark, sf_dir).count() > 0


def test_entry_point(spark, sf_dir):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
