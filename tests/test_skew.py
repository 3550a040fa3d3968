"""A third of all order lines on one product, one order and one customer."""

import duckdb
import pytest

from compare import connect, differences
from loanloom.plans.oracle import ORACLE
from loanloom.plans.queries import QUERIES
from loanloom.sources import borrowers


@pytest.fixture(scope="module")
def skewed(folder, tmp_path_factory):
    target = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    changed = {
        "lineitem": """SELECT * REPLACE (
            CASE WHEN rowid % 3 = 0 THEN (SELECT min(o_orderkey) FROM orders) ELSE l_orderkey END AS l_orderkey,
            CASE WHEN rowid % 3 = 0 THEN (SELECT min(p_partkey) FROM part) ELSE l_partkey END AS l_partkey)
            FROM (SELECT *, row_number() OVER () AS rowid FROM lineitem)""",
        "orders": """SELECT * REPLACE (
            CASE WHEN o_orderkey % 3 = 0 THEN (SELECT min(c_custkey) FROM customer) ELSE o_custkey END AS o_custkey)
            FROM orders""",
        # a third of all customers share one income and so one expected loss per probability
        "customer": """SELECT * REPLACE (
            CASE WHEN c_custkey % 3 = 0 THEN 1000.0 ELSE c_acctbal END AS c_acctbal) FROM customer""",
    }
    for name in ("customer", "orders", "lineitem", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for name in ("customer", "orders", "lineitem", "part"):
        body = changed.get(name, f"SELECT * FROM {name}")
        if name == "lineitem":
            body = body.replace("SELECT * REPLACE", "SELECT * EXCLUDE (rowid) REPLACE")
        con.execute(f"COPY ({body}) TO '{target}/{name}.parquet' (FORMAT parquet, ROW_GROUP_SIZE 2048)")
    for name in ("region", "nation", "supplier", "events", "documents", "embeddings", "pages", "benchmark",
                 "labels", "conversations"):
        con.execute(f"COPY (SELECT * FROM '{folder}/{name}.parquet') TO '{target}/{name}.parquet' (FORMAT parquet)")
    return str(target)


@pytest.mark.parametrize("name", ["borrower_records", "silver_features", "portfolio_ranks", "auc_exact", "roc_points",
                                  "gini_income", "describe_income_by_grade", "portfolio_summary", "key_reconciliation",
                                  "enquiry_lift", "single_feature_auc", "policy_simulation"])
def test_matches_sql_under_skew(spark, skewed, name):
    assert differences(QUERIES[name](spark, skewed), connect(skewed), ORACLE[name]) == []


def test_hot_product_is_split_at_run_time(spark, skewed):
    """With thresholds scaled down to the test data, adaptive execution splits the hot side."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB", "spark.sql.files.maxPartitionBytes": "16KB",
             "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        df = QUERIES["borrower_records"](spark, skewed)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    joins = [line for line in plan.split("== Initial Plan ==")[0].splitlines() if "SortMergeJoin" in line]
    assert any("skew=true" in line and "l_partkey" in line for line in joins)
    # lines are collapsed per order before the orders are joined: that join has no hot key left
    assert not any("skew=true" in line and "l_orderkey" in line for line in joins)


def test_lines_without_product_still_count(spark, folder, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{folder}/part.parquet' WHERE p_partkey % 2 = 0) TO '{tmp_path}/part.parquet'")
    for name in ("customer", "orders", "lineitem"):
        con.execute(f"COPY (SELECT * FROM '{folder}/{name}.parquet') TO '{tmp_path}/{name}.parquet'")
    totals = [borrowers.order_summary(spark, where).selectExpr("sum(lines)", "sum(loans)", "sum(late)", "sum(missed)").first()
              for where in (folder, str(tmp_path))]
    assert totals[0] == totals[1]


def test_lines_are_not_counted_before_their_order_is_together(spark, folder):
    # counts held for lines that lie anywhere would be a wide group for nearly each of them
    plan = borrowers.order_summary(spark, folder)._jdf.queryExecution().executedPlan().toString()
    upper, lower = plan.split("REPARTITION_BY_COL", 1)
    assert "HashAggregate" in upper and "HashAggregate" not in lower.split("Subquery")[0]
