"""Every query with an SQL counterpart, at the smallest scale, value by value."""

import pytest

from compare import connect, differences
from loanloom.plans.oracle import ORACLE
from loanloom.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_check_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, folder, con, name):
    assert differences(QUERIES[name](spark, folder), con, ORACLE[name]) == []


def test_entry_point(spark):
    import __spark_entry__ as entry_module
    assert entry_module.entry(spark).count() == 1
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
