import math
import random

import numpy as np
import pytest

from loanloom.operators import profile, quality, stats


def test_quality_checks_find_faults(spark):
    df = spark.createDataFrame(
        [(1, 700, 1, 10.0, 30, "Unknown"), (1, 299, 0, -1.0, None, "Low Risk"), (2, None, 0, 5.0, 40, "High Risk")],
        "PROSPECTID long, Credit_Score int, default_risk int, NETMONTHLYINCOME double, AGE int, grade_band string")
    checks = {r["check_name"]: r for r in quality.quality_checks(df).collect()}
    failed = {n for n, r in checks.items() if not r["passed"]}
    assert failed == {"Credit_Score_nulls", "AGE_nulls", "score_out_of_range", "risky_minus_safe_score",
                      "grade_band_unknown", "negative_income", "duplicate_keys"}
    assert checks["duplicate_keys"]["value"] == 1.0 and checks["score_out_of_range"]["value"] == 2.0
    assert quality.all_passed(quality.quality_checks(df)).first()[0] is False


def test_quality_checks_of_one_class(spark):
    df = spark.createDataFrame([(1, 700, 0)], "PROSPECTID long, Credit_Score int, default_risk int")
    checks = {r["check_name"]: r["passed"] for r in quality.quality_checks(df).collect()}
    assert checks["risky_minus_safe_score"] is False


@pytest.mark.parametrize("left, right, expected", [
    ([1, 2, 2], [2, 1], (2, 2, 2, 0, 0, "perfect")), ([1, 2], [2, 3, 4], (2, 3, 1, 1, 2, "partial")),
    ([1], [2], (1, 1, 0, 1, 1, "none")), ([None, 1], [1], (1, 1, 1, 0, 0, "perfect"))])
def test_key_reconciliation(spark, left, right, expected):
    a, b = (spark.createDataFrame([(k,) for k in keys], "PROSPECTID long") for keys in (left, right))
    assert tuple(quality.key_reconciliation(a, b).first()) == expected


def test_sentinel_scan(spark):
    df = spark.createDataFrame([(-99999, 1.0, "-99999"), (2, -99999.0, "x"), (None, -99999.0, "x")], "a long, b double, c string")
    assert {r["column_name"]: r["marked_rows"] for r in quality.sentinel_scan(df).collect()} == {"a": 1, "b": 2}


def test_column_profile(spark):
    df = spark.createDataFrame([(None, "x" * 50, None), (3, "y", None)], "a int, b string, c double")
    out = {r["column_name"]: r for r in profile.column_profile(df).collect()}
    assert out["a"]["null_pct"] == 50.0 and out["a"]["sample_value"] == "3"
    assert out["c"]["sample_value"] == "N/A" and out["c"]["data_type"] == "double"
    assert out["b"]["sample_value"] in ("x" * 40 + "...", "y")
    assert profile.preview(df, 1).count() == 1


def test_describe_and_counts(spark):
    rows = [("a", float(i)) for i in range(11)] + [("b", 1.0), (None, 9.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    out = {r["g"]: r for r in profile.describe_by(df, "g", "x").collect()}
    assert set(out) == {"a", "b"}
    a = out["a"]
    assert (a["count"], a["mean"], a["min"], a["q25"], a["median"], a["q75"], a["max"]) == (11, 5.0, 0.0, 2.5, 5.0, 7.5, 10.0)
    assert out["b"]["std"] is None
    assert [(r["g"], r["count"]) for r in profile.value_counts(df, "g").collect()] == [("a", 11), ("b", 1)]


def test_source_summary_counts_duplicates(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 7.0), (3, None)], "k long, v double")
    out = profile.source_summary(df, "k", ["v"]).first()
    assert (out["row_count"], out["distinct_keys"], out["duplicate_keys"]) == (3, 2, 1)
    assert (out["min_v"], out["max_v"], out["mean_v"]) == (5.0, 7.0, 6.0)


# ---- statistics ------------------------------------------------------------------------------------------

def direct_gini(numbers):
    v = np.sort(np.array(numbers, dtype=float))
    n = len(v)
    return 2 * float((np.arange(1, n + 1) * v).sum()) / (n * float(v.sum())) - (n + 1) / n


@pytest.mark.parametrize("numbers", [[5.0] * 20, [0.0] * 9 + [1.0], [1.0, 1.0, 2.0, 2.0, 2.0, 9.0],
                                     [random.Random(5).lognormvariate(1, 1) for _ in range(700)]])
def test_gini_against_the_definition(spark, numbers):
    df = spark.createDataFrame([(v,) for v in numbers], "x double")
    assert stats.gini(df, "x").first()["gini"] == pytest.approx(direct_gini(numbers), abs=1e-12)


def test_gini_tiers_need_more_than_ten(spark):
    rows = [("ten", 700 + i, 0) for i in range(10)] + [("eleven", 600 + i, 1) for i in range(11)]
    out = stats.gini_by_tier(spark.createDataFrame(rows, "income_tier string, cibil_score int, default_risk int")).collect()
    assert [r["income_tier"] for r in out] == ["eleven"]
    assert out[0]["gini_score"] == pytest.approx(direct_gini(range(600, 611)))


def test_score_bands_and_steepest_drop(spark):
    rows = [(s, d, 1.0, 1) for s, d in ((299, 1), (300, 1), (319, 1), (345, 1), (345, 0), (799, 0), (800, 0))]
    table = stats.score_band_table(spark.createDataFrame(
        rows, "cibil_score int, default_risk int, monthly_income_inr double, total_loans long"))
    out = table.collect()
    assert [(r["score_band"], r["borrowers"], r["default_rate_pct"]) for r in out] == [
        ("300-319", 2, 100.0), ("340-359", 2, 50.0), ("780-799", 1, 0.0)]
    assert [r["rate_change"] for r in out] == [None, -50.0, -50.0]
    assert stats.steepest_band(table).first()["score_band"] == "340-359"


def signal_rows(n=400):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        rows.append((i, y, 0, rng.gauss(y, 1), rng.gauss(0, 1), float(y) if i < 50 else None, 3.0))
    return rows


SIGNALS = "borrower_id long, default_risk int, risk_score int, strong double, noise double, sparse double, flat double"


def test_signals(spark):
    rows = signal_rows()
    df = spark.createDataFrame(rows, SIGNALS)
    table = {r["feature"]: r for r in stats.signal_table(df).collect()}
    assert set(table) == {"strong", "noise"}  # too few values, no variance: left out
    y, x = np.array([r[1] for r in rows]), np.array([r[3] for r in rows])
    assert table["strong"]["correlation"] == pytest.approx(abs(np.corrcoef(x, y)[0, 1]))
    ranked = stats.early_warning_signals(df).collect()
    assert ranked[0]["feature"] == "strong" and ranked[0]["rank"] == 1


def test_critical_value_series(spark):
    from pyspark.sql import functions as F
    # tabulated two-sided 5 % limits of Student's t
    known = {100: 1.983971519, 120: 1.979930405, 500: 1.964719837, 1000: 1.962339081}
    got = spark.range(1).select(*[stats.t_critical(F.lit(n)).alias(str(n)) for n in known]).first()
    for n, limit in known.items():
        assert got[str(n)] == pytest.approx(limit, abs=2e-7)


def test_p_values_agree_with_t(spark):
    df = spark.createDataFrame(signal_rows(), SIGNALS)
    found = {r["feature"]: r for r in stats.group_p_values(df, ["strong", "noise", "sparse"], "default_risk").collect()}
    t = {r["feature"]: r["t_statistic"] for r in stats.signal_table(df).collect()}
    for name in ("strong", "noise"):
        assert found[name]["f_value"] == pytest.approx(t[name] ** 2)
        assert found[name]["significant"] == (abs(t[name]) > 1.9659)
    assert 0.0 <= found["noise"]["p_value"] <= 1.0 and found["strong"]["p_value"] < 1e-6
    assert "sparse" in found


def test_two_sample_t(book):
    fact = book.gold("fact_credit_risk")
    t = stats.ttest_gold(fact).first()
    p = stats.ttest_gold_p_value(fact).first()
    assert p["f_value"] == pytest.approx(t["t_statistic"] ** 2)
    assert t["n_gold"] + t["n_other"] == fact.count()


def test_comparisons(spark):
    df = spark.createDataFrame([(1, 10, 2.0), (0, 20, 4.0), (0, 40, None)], "default_risk int, cibil_score int, total_loans double")
    out = {r["feature"]: r for r in stats.risky_vs_safe(df).collect()}
    assert set(out) == {"cibil_score", "total_loans"}
    assert out["cibil_score"]["difference"] == -20.0
    assert math.isclose(out["total_loans"]["pct_difference"], -2.0 / (4.0 + 1e-6) * 100)
