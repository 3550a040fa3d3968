import pytest
from pyspark.sql import functions as F

from loanloom.operators import explain

KINDS = ("borrower_id long, predicted_pd double, enq_L6m long, num_times_delinquent long, num_times_60p_dpd long, "
         "missed_payment_ratio double, Age_Oldest_TL long, NETMONTHLYINCOME double")


def people(spark, *rows):
    return spark.createDataFrame(list(rows), KINDS)


def test_levels_and_recommendations(spark):
    df = spark.createDataFrame([(p,) for p in (0.6, 0.59, 0.35, 0.34)], "predicted_pd double")
    pd = F.col("predicted_pd")
    assert [r[0] for r in df.select(explain.risk_level(pd)).collect()] == ["HIGH RISK", "MEDIUM RISK", "MEDIUM RISK", "LOW RISK"]
    assert df.select(explain.recommendation(pd)).first()[0].startswith("Decline or escalate")


def test_rule_reasons(spark):
    quiet, loud = explain.explain(people(spark, (1, 0.1, 3, 1, 0, 0.0, 47, 24999.0), (2, 0.72, 4, 2, 1, 0.5, 48, 1234567.0)),
                                  top_n=2).orderBy("borrower_id").collect()
    assert quiet["risk_reasons"] == [] and quiet["protective_factors"] == []
    assert quiet["summary"].endswith("No significant risk signals detected.")
    assert [e["feature"] for e in loud["risk_reasons"]] == ["enq_L6m", "num_times_delinquent"]  # cut to two
    assert loud["risk_reasons"][0]["reason"] == "Applied to 4 lenders in the last 6 months — indicates financial stress"
    assert loud["protective_factors"][1]["reason"] == "Monthly income of ₹1,234,567 — good repayment capacity"
    assert loud["summary"].startswith("Predicted default probability: 72.0%. Primary concern: Applied to 4")
    assert (loud["risk_reasons"][0]["shap"], loud["risk_reasons"][0]["label"]) == (0.9, "Recent enquiries")


def test_absent_columns_take_defaults(spark):
    out = explain.rule_reasons(people(spark, (1, 0.1, 9, 0, 0, 0.0, 1, 1.0)).drop("Age_Oldest_TL", "NETMONTHLYINCOME")).first()
    assert [e["value"] for e in out["protective_factors"]] == [120.0, 30000.0]


def test_batch(spark):
    out = explain.batch_explain(people(spark, (7, 0.4, 0, 0, 0, 0.0, 0, 0.0), (8, 0.4, 5, 0, 0, 0.0, 0, 0.0))).orderBy("borrower_id").collect()
    assert [r["primary_reason"] for r in out] == ["—", "Applied to 5 lenders in the last 6 months — indicates financial stress"]
    assert out[0]["recommendation"] == "Proceed with additional documentation. Request 6-month bank ..."
    assert len(out[0]["recommendation"]) == 63


def test_attribution_order_cutoff_and_sides(spark):
    df = spark.createDataFrame(
        [(1, 0.5, 5.0, 30.0, 0.3, 2.0, 0.9, -0.9, 0.05, -0.2)],
        "borrower_id long, predicted_pd double, enq_L6m double, Age_Oldest_TL double, AGE double, Home_TL double, "
        "p1 double, p2 double, p3 double, p4 double")
    told = explain.attribution_reasons(df, {"enq_L6m": "p1", "Age_Oldest_TL": "p2", "AGE": "p3", "Home_TL": "p4"}, top_n=2).first()
    assert [(e["feature"], e["shap"]) for e in told["risk_reasons"]] == [("enq_L6m", 0.9)]
    assert [e["feature"] for e in told["protective_factors"]] == ["Age_Oldest_TL", "Home_TL"]
    assert told["protective_factors"][0]["reason"] == "30-month credit history — strong repayment track record"
    assert told["protective_factors"][1]["reason"] == "Home loan accounts: 2.0 (reduces risk)"
    one = explain.attribution_reasons(df, {"enq_L6m": "p1", "Age_Oldest_TL": "p2", "AGE": "p3", "Home_TL": "p4"}, top_n=1).first()
    assert len(one["protective_factors"]) == 1


@pytest.mark.parametrize("feature, value, expected", [
    ("Age_Oldest_TL", 23.0, "Credit history of only 23 months — insufficient track record"),
    ("Age_Oldest_TL", 24.0, "Established 24-month credit history — positive stability signal"),
    ("NETMONTHLYINCOME", 20000.0, "Monthly income of ₹20,000 — limited repayment buffer"),
    ("NETMONTHLYINCOME", 20001.0, "Monthly income of ₹20,001 — adequate repayment capacity"),
    ("missed_payment_ratio", 0.125, "Missed 12% of payments — high missed payment frequency"),
    ("active_loan_ratio", 0.6, "60% of loans are currently active — heavily overextended"),
    ("delinquency_score", 12.0, "Delinquency severity score of 12 — above risk threshold"),
    ("Gold_TL", 2.0, "Has 2 gold loan(s) — may indicate collateral-backed stress borrowing"),
    ("enq_acceleration", 1.0, "Enquiry pace has increased recently — accelerating credit search")])
def test_sentences(spark, feature, value, expected):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(explain.risk_sentence(feature, F.col("v"))).first()[0] == expected


def test_application_reasons(spark):
    out = explain.application_reasons(people(spark, (1, 0.7, 5, 3, 1, 0.3, 40, 30000.0), (2, 0.1, 0, 0, 0, 0.2, 35, 1.0))).orderBy(
        "borrower_id").collect()
    assert out[0]["reason_count"] == 5 and "~ CAUTION: 30% of payments missed" in out[0]["reasons"]
    assert "₹" not in out[0]["reasons"]  # the sixth is cut
    assert (out[1]["reasons"], out[1]["recommendation"]) == ("", "Approve under standard terms.")


def test_odd_values_do_not_break_sentences(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 0.5, nan, 1.0, None, 0.9), (2, 0.5, 3.0, 1.0, nan, -0.9)],
                               "borrower_id long, predicted_pd double, enq_L6m double, AGE double, p1 double, p2 double")
    out = explain.attribution_reasons(df, {"enq_L6m": "p1", "AGE": "p2"}, top_n=1).orderBy("borrower_id").collect()
    assert [len(r["risk_reasons"]) for r in out] == [1, 0]
    assert out[1]["protective_factors"][0]["feature"] == "AGE"
    assert explain.rule_reasons(df.select("enq_L6m"), 1).count() == 2
    explain.rule_reasons(df.select("enq_L6m"), 1).collect()
