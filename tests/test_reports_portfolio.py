import pytest
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.operators import export, portfolio, quality, reports

LOANS = ("borrower_id long, default_risk int, enq_L6m long, Age_Oldest_TL long, num_times_delinquent long, "
         "num_times_60p_dpd long, missed_payment_ratio double, active_loan_ratio double")


def loans(spark, rows):
    return spark.createDataFrame(rows, LOANS).withColumn("NETMONTHLYINCOME", F.lit(1000.0))


def test_funnel_without_any_delinquency(spark):
    df = loans(spark, [(1, 0, 0, 50, 0, 0, 0.0, 0.0)])
    rows = reports.delinquency_funnel(df).collect()
    assert [r["stage"] for r in rows] == list(K.FUNNEL_STAGES)
    assert [r["transition_rate_from_prev"] for r in rows] == [None] * 4
    assert [r["rate"] for r in portfolio.funnel_transitions(df).collect()] == [0.0, 0.0, 0.0]


def test_rules_that_flag_nobody(spark):
    df = loans(spark, [(1, 0, 0, 50, 0, 0, 0.0, 0.0)])
    out = reports.high_risk_rules(df).collect()
    assert len(out) == 4 and all(r["flagged_count"] == 0 and r["default_rate_in_segment"] is None for r in out)


def test_policy_impact_without_defaults(spark):
    out = reports.policy_impact(loans(spark, [(1, 0, 9, 5, 0, 0, 0.0, 0.0)])).first()
    assert out["pct_defaults_caught_policy1"] is None and out["estimated_npa_after_policies"] == 0.0


def test_intervention_list(spark):
    df = loans(spark, [
        (1, 0, 4, 10, 0, 0, 0.0, 0.0), (2, 0, 4, 50, 0, 0, 0.0, 0.0), (3, 0, 2, 10, 0, 0, 0.0, 0.0),
        (4, 0, 0, 99, 2, 0, 0.0, 0.0), (5, 0, 0, 99, 0, 0, 0.2, 0.0), (6, 1, 9, 5, 9, 9, 1.0, 1.0),
        (7, 0, 1, 99, 1, 1, 0.1, 1.0)])
    out = reports.early_intervention(df).collect()
    assert [r["borrower_id"] for r in out] == [1, 2, 3, 4, 5]
    assert [r["intervention_priority"].split(" ")[0] for r in out] == ["EXTREME", "HIGH", "MEDIUM", "MEDIUM", "LOW"]
    assert [r["borrower_id"] for r in reports.early_intervention(df, 2).collect()] == [1, 2]
    assert [(r["borrower_id"], r["priority"]) for r in portfolio.watchlist(df).collect()] == [
        (1, "EXTREME"), (2, "HIGH"), (4, "MEDIUM")]


def test_report_rounding(book):
    tables = {n: book.operational(n) for n in ("borrowers", "risk_segments")}
    assert len(reports.REPORTS) == 10
    shown = reports.REPORTS["01_portfolio_health"].run(tables).first()
    plain = reports.portfolio_health(tables["borrowers"]).first()
    assert shown["avg_age"] == pytest.approx(plain["avg_age"], abs=0.05)
    assert shown["avg_monthly_income"] == float(int(shown["avg_monthly_income"]))


# ---- portfolio -----------------------------------------------------------------------------------------

PD_ROWS = "predicted_pd double, default_risk int, NETMONTHLYINCOME double, AGE int"


def test_empty_probability_bands_are_listed(spark):
    out = portfolio.pd_band_distribution(spark.createDataFrame([(0.1, 0, 1.0, 30), (1.0, 1, 1.0, 30)], PD_ROWS)).collect()
    assert [(r["risk_band"], r["count"]) for r in out] == [("Low Risk", 1), ("Medium Risk", 0), ("High Risk", 0)]
    assert [r["pct_of_portfolio"] for r in out] == [50.0, 0.0, 0.0]


def test_unlisted_segments_stay_in_totals(spark):
    df = spark.createDataFrame([(0.1, 1, 1.0, 18), (0.1, 1, 1.0, 19), (0.1, 0, 1.0, 19), (0.1, 0, 1.0, 76)], PD_ROWS)
    out = portfolio.segment_default_rates(df, "AGE", *K.LEADERBOARD_AGE_BAND).collect()
    assert len(out) == 1
    assert (out[0]["count"], out[0]["default_rate_pct"], out[0]["risk_contribution_pct"], out[0]["pct_of_portfolio"]) == (
        2, 50.0, 50.0, 50.0)


def test_contribution_keeps_borrowers_without_value_in_the_total(spark):
    df = spark.createDataFrame([(0.1, 1, 5000.0, 30), (0.1, 1, None, 30)], PD_ROWS)
    out = portfolio.segment_contribution(df, "income").collect()
    assert [(r["segment"], r["contribution_pct"]) for r in out] == [("<10k", 50.0)]


def test_leaderboard_ranks(book):
    out = portfolio.riskiest_segments(book.silver(), 4).orderBy("rank").collect()
    assert [r["rank"] for r in out] == [1, 2, 3, 4]
    assert [r["default_rate_pct"] for r in out] == sorted((r["default_rate_pct"] for r in out), reverse=True)


def test_summary_agrees_with_bands(book):
    summary = portfolio.portfolio_summary(book.scored()).first()
    bands = {r["risk_band"]: r["count"] for r in portfolio.pd_band_distribution(book.scored()).collect()}
    assert (summary["low_risk_count"], summary["medium_risk_count"], summary["high_risk_count"]) == tuple(
        bands[n] for n in ("Low Risk", "Medium Risk", "High Risk"))
    assert sum(bands.values()) == summary["total_borrowers"]


def test_histogram_sums_to_one(book):
    out = portfolio.pd_histogram(book.scored()).groupBy("default_risk").agg(F.sum("probability").alias("p")).collect()
    assert [r["p"] for r in out] == pytest.approx([1.0, 1.0])


# ---- export -----------------------------------------------------------------------------------------------

def test_export_edges(spark):
    df = spark.createDataFrame(
        [(1, 0.25, 0, 25, "1000", 7, 0, 12), (2, 0.50, 1, 26, "-5", 1, 3, 13), (3, 0.65, 1, 0, "abc", 0, 6, 97),
         (4, 1.00, None, 56, None, None, None, None)],
        "PROSPECTID long, predicted_pd double, default_risk int, AGE int, NETMONTHLYINCOME string, tot_enq long, "
        "num_times_delinquent long, Age_Oldest_TL long")
    out = {r["PROSPECTID"]: r for r in export.scored_export(df).collect()}
    assert [out[i]["pd_band"] for i in (1, 2, 3, 4)] == ["Low Risk", "Medium Risk", "High Risk", "High Risk"]
    assert [out[i]["approved_flag"] for i in (1, 2, 3, 4)] == [1, 0, 0, 0]
    assert [out[i]["watchlist_flag"] for i in (1, 2, 3, 4)] == [0, 0, 1, 1]
    assert [out[i]["ead_proxy"] for i in (1, 2, 3, 4)] == [12000.0, 0.0, 0.0, 0.0]
    assert [out[i]["age_band"] for i in (1, 2, 3, 4)] == ["<=25", "26-35", "Unknown", "55+"]
    assert [out[i]["enquiry_band"] for i in (1, 2, 3, 4)] == ["7+", "0-1", "0-1", "0-1"]
    assert [out[i]["delinquency_band"] for i in (1, 2, 3, 4)] == ["0", "3-5", "6+", "0"]
    assert [out[i]["credit_history_band"] for i in (1, 2, 3, 4)] == ["<1yr", "1-2yr", "8yr+", "Unknown"]
    assert [out[i]["risk_rank"] for i in (1, 2, 3, 4)] == [4, 3, 2, 1]
    assert [out[i]["loss_rank"] for i in (1, 2, 3, 4)] == [1, 2, 2, 2]
    assert out[4]["default_actual_label"] == 0


def test_export_order_and_names(book):
    frame = export.scored_export(book.scored())
    assert frame.columns[:3] == ["PROSPECTID", "predicted_pd", "pd_band"]
    assert frame.columns[len(export.BUSINESS_COLUMNS) + 1] == K.FEATURES[0]
    assert "risk_band" in export.named_for_sink(frame).columns
    assert "risk_band" in export.named_for_sink(book.silver()).columns
    blanks = quality.blank_bands(frame).collect()
    assert len(blanks) == 5 and all(r["blank_rows"] == 0 for r in blanks)
