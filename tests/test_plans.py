"""What the physical plans must and must not contain."""

import re

import pytest

from loanloom.operators import policy, portfolio, reports, scoring
from loanloom.plans.queries import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(plan):
    return len(re.findall(r"FileScan parquet", plan))


@pytest.mark.parametrize("operator, layer", [
    (reports.portfolio_health, "borrowers"), (reports.delinquency_funnel, "borrowers"),
    (reports.high_risk_rules, "borrowers"), (reports.policy_impact, "borrowers"), (reports.default_by_segment, "risk_segments"),
    (reports.income_vs_default, "borrowers"), (reports.history_vs_default, "borrowers"), (portfolio.funnel_transitions, "borrowers")])
def test_reports_scan_once(book, operator, layer):
    assert scans(plan_of(operator(book.operational(layer)))) == 1


@pytest.mark.parametrize("operator", [
    scoring.threshold_table, scoring.threshold_sweep, scoring.confusion_matrix,
    lambda df: policy.simulate_policies(df, policy.PRESETS), policy.compare_policies, portfolio.portfolio_summary])
def test_scored_operators_scan_once(book, operator):
    assert scans(plan_of(operator(book.scored()))) == 1


def test_reports_read_only_their_columns(book):
    plan = plan_of(reports.delinquency_funnel(book.operational("borrowers")))
    read = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert set(re.findall(r"(\w+):", read)) == {"num_times_delinquent", "num_times_60p_dpd", "default_risk"}


def test_filters_reach_the_scan(book):
    plan = plan_of(reports.early_intervention(book.operational("borrowers")))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(default_risk,0\)", plan)
    assert "TakeOrderedAndProject" in plan


def test_borrower_records_shape(spark, folder):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES["borrower_records"](spark, folder))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # lines by product, lines by order, orders, products, customers twice: nothing else moves
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 6


WHOLE_TABLE = ["portfolio_ranks", "scored_export", "auc_exact", "roc_points", "pr_points", "gini_income",
               "describe_income_by_grade", "single_feature_auc"]


@pytest.mark.parametrize("name", WHOLE_TABLE)
def test_no_window_over_all_rows(spark, folder, name):
    """A window without partition keys may only see range totals, never rows or values."""
    plan = plan_of(QUERIES[name](spark, folder))
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = lines[i + 1]
            assert "Aggregate" in below and ("_range" in below or "keys=[]" in below), below


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {
    "gbt_metrics", "gbt_scores", "cross_validation", "weight_sweep", "best_weight", "tuned_model", "model_comparison",
    "attributions", "importance", "borrower_clusters"}))
def test_no_python_and_no_cross_joins(spark, folder, name):
    plan = plan_of(QUERIES[name](spark, folder))
    for forbidden in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct",
                      "BroadcastNestedLoopJoin"):
        assert forbidden not in plan, forbidden
