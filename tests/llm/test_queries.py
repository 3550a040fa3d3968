"""Queries of the corpus operators against SQL, and their plans."""

import pytest
from compare import connect, differences

from loanloom.llm.queries import ORACLE, QUERIES

NATIVE = ("op1_chat_format", "op5_url_filter", "op6_line_dedup", "op8_syncmer_fingerprints", "op10_mix")


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, folder, con, name):
    assert differences(QUERIES[name](spark, folder), con, ORACLE[name]) == []


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def test_entry_has_them_all():
    import __spark_entry__ as entry
    names = entry.queries()
    assert set(QUERIES) <= set(names) and "pipeline" in names
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
