import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanloom.operators import policy, scoring


def scores(spark, rows):
    return spark.createDataFrame(rows, "predicted_pd double, default_risk int")


def brute_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def tied_rows(n=400, seed=3):
    rng = random.Random(seed)
    return [(round(rng.random(), 1) if i % 3 else 0.3, int(rng.random() < 0.4)) for i in range(n)]


@pytest.mark.parametrize("rows", [tied_rows(), [(0.1, 0), (0.9, 1)], [(0.5, 1), (0.5, 0)], [(0.2, 1)], [(0.3, 0), (0.4, 0)]])
def test_auc_against_all_pairs(spark, rows):
    got = scoring.auc(scores(spark, rows)).first()["auc"]
    expected = brute_auc(rows)
    assert got is None if expected is None else got == pytest.approx(expected)


def test_auc_equals_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector
    df = scores(spark, tied_rows()).withColumn("raw", array_to_vector(F.array("predicted_pd")))
    judge = BinaryClassificationEvaluator(rawPredictionCol="predicted_pd", labelCol="default_risk", numBins=0)
    assert scoring.auc(df).first()["auc"] == pytest.approx(judge.evaluate(df))


def test_roc_curve_points(spark):
    rows = tied_rows()
    n_pos = sum(y for _, y in rows)
    full = scoring.roc_points(scores(spark, rows), drop_collinear=False).collect()
    for point in full:
        if point["threshold"] is not None:
            tp = sum(y for s, y in rows if s >= point["threshold"])
            fp = sum(1 - y for s, y in rows if s >= point["threshold"])
            assert (point["tpr"], point["fpr"]) == pytest.approx((tp / n_pos, fp / (len(rows) - n_pos)))
    kept = scoring.roc_points(scores(spark, rows)).collect()
    assert {p["threshold"] for p in kept} <= {p["threshold"] for p in full}
    # the shorter curve encloses the same area
    def area(points):
        xy = sorted((p["fpr"], p["tpr"]) for p in points)
        return float(np.trapezoid([y for _, y in xy], [x for x, _ in xy]))
    assert area(kept) == pytest.approx(area(full)) == pytest.approx(brute_auc(rows))


def test_average_precision(spark):
    rows = tied_rows()
    n_pos, total, previous = sum(y for _, y in rows), 0.0, 0.0
    for t in sorted({s for s, _ in rows}, reverse=True):
        above = [y for s, y in rows if s >= t]
        total += (sum(above) / n_pos - previous) * sum(above) / len(above)
        previous = sum(above) / n_pos
    assert scoring.average_precision(scores(spark, rows)).first()["average_precision"] == pytest.approx(total)


def test_collinear_points_go(spark):
    # equal steps in the middle: the curve is one straight line after the first point
    rows = [(0.9, 1), (0.8, 1), (0.7, 1), (0.6, 0), (0.5, 0)]
    kept = {p["threshold"] for p in scoring.roc_points(scores(spark, rows)).collect()}
    assert kept == {None, 0.9, 0.7, 0.5}


def test_confusion_and_zero_divisors(spark):
    nobody = scoring.confusion_matrix(scores(spark, [(0.1, 1), (0.2, 0)])).first()
    assert (nobody["tp"], nobody["fp"], nobody["fn"], nobody["tn"]) == (0, 0, 1, 1)
    assert (nobody["precision"], nobody["recall"], nobody["f1"]) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("cutoffs", [(0.2, 0.5, 0.7), (0.3,), scoring.sweep_grid()])
def test_cutoffs_against_brute_force(spark, cutoffs):
    rows = tied_rows() + [(cutoffs[0], 1), (cutoffs[-1], 0), (0.0, 0), (1.0, 1)]
    for r in scoring.counts_at_cutoffs(scores(spark, rows), cutoffs).collect():
        t = r["cutoff"]
        cells = [sum((s >= t) == f and y == c for s, y in rows) for f, c in ((True, 1), (True, 0), (False, 1), (False, 0))]
        assert [r["tp"], r["fp"], r["fn"], r["tn"]] == cells


def test_sweep_has_81_points():
    grid = scoring.sweep_grid()
    assert len(grid) == 81 and round(grid[0], 2) == 0.1 and round(grid[-1], 2) == 0.9


def sweep(spark, rows):
    return spark.createDataFrame(rows, "threshold double, precision double, recall double, f1 double")


def test_best_threshold_rules(spark):
    enough = scoring.best_threshold(sweep(spark, [(0.1, 0.5, 0.9, 0.6), (0.2, 0.7, 0.8, 0.75), (0.3, 0.7, 0.76, 0.75),
                                                  (0.4, 0.9, 0.5, 0.65)])).collect()
    assert [(r["rule"], r["threshold"]) for r in enough] == [("best_f1", 0.2), ("best_precision", 0.2)]
    fallback = scoring.best_threshold(sweep(spark, [(0.1, 0.5, 0.7, 0.6), (0.2, 0.9, 0.3, 0.4)])).collect()
    assert [r["threshold"] for r in fallback] == [0.1, 0.1]


def test_rule_pd_limits(spark):
    kinds = ("enq_L6m long, num_times_delinquent long, missed_payment_ratio double, active_loan_ratio double, "
             "num_times_60p_dpd long, Age_Oldest_TL long, NETMONTHLYINCOME double")
    rows = [(60, 100, 10.0, 1.0, 9, 0, 0.0), (0, 0, 0.0, 0.0, 0, 9999, 1e9), (5, 3, 0.30, 0.60, 1, 18, 15000.0),
            (None,) * 7]
    out = [r[0] for r in spark.createDataFrame(rows, kinds).select(scoring.rule_pd()).collect()]
    assert out[:2] == [0.97, 0.02] and out[3] == 0.02
    expected = (5 / 6 * 0.30 + 0.3 * 0.25 + 0.30 * 0.20 + 0.60 * 0.15 + 1 / 3 * 0.10 - (5000 / 490000) * 0.10)
    assert out[2] == pytest.approx(expected)


# ---- policies ------------------------------------------------------------------------------------

KINDS = ("id int, enq_L6m long, Age_Oldest_TL long, num_times_delinquent long, num_times_60p_dpd long, "
         "NETMONTHLYINCOME double, predicted_pd double, active_loan_ratio double, default_risk int")
BASE = dict(id=0, enq_L6m=1, Age_Oldest_TL=60, num_times_delinquent=0, num_times_60p_dpd=0, NETMONTHLYINCOME=50000.0,
            predicted_pd=0.2, active_loan_ratio=0.5, default_risk=0)


def applicants(spark, *changes):
    return spark.createDataFrame([tuple({**BASE, "id": i, **c}.values()) for i, c in enumerate(changes)], KINDS)


def approved(df, rules):
    return [r["approved"] for r in policy.apply_policy(df, rules).orderBy("id").collect()]


def test_missing_values_fail_rules_except_income(spark):
    df = applicants(spark, {}, {"enq_L6m": None}, {"Age_Oldest_TL": None}, {"num_times_delinquent": None},
                    {"num_times_60p_dpd": None}, {"NETMONTHLYINCOME": None}, {"predicted_pd": None},
                    {"active_loan_ratio": None})
    assert approved(df, policy.CURRENT) == [True, False, False, False, False, True, False, False]
    assert approved(df, policy.CONSERVATIVE)[5] is False  # income counts as 0


def test_limits_are_inclusive(spark):
    df = applicants(spark, {"enq_L6m": 3}, {"enq_L6m": 4}, {"Age_Oldest_TL": 12}, {"Age_Oldest_TL": 11},
                    {"NETMONTHLYINCOME": 10000.0}, {"NETMONTHLYINCOME": 9999.0}, {"predicted_pd": 0.45}, {"predicted_pd": 0.46})
    assert approved(df, policy.CONSERVATIVE) == [True, False] * 4


def test_absent_columns_switch_rules_off(spark):
    df = applicants(spark, {"enq_L6m": 50}).drop("enq_L6m")
    assert approved(df, policy.CONSERVATIVE) == [True]


def test_simulation_numbers(spark):
    df = applicants(spark, {}, {"default_risk": 1, "enq_L6m": 9}, {"enq_L6m": 9}, {"default_risk": 1})
    out = policy.simulate_policy(df, policy.CONSERVATIVE).first()
    assert (out["n_approved"], out["n_rejected"], out["n_total"]) == (2, 2, 4)
    assert (out["defaults_in_approved"], out["defaults_prevented"], out["safe_borrowers_rejected"]) == (1, 1, 1)
    one = 0.2 * 0.45 * 600000
    assert out["expected_loss_cr"] == pytest.approx(2 * one / 1e7)
    assert out["el_reduction_pct"] == pytest.approx(50.0)
    assert out["raae"] == pytest.approx(0.5)
    assert out["defaults_prevented_vs_baseline"] == 1


def test_simulation_against_a_strict_baseline(spark):
    df = applicants(spark, {}, {"default_risk": 1, "enq_L6m": 9}, {"enq_L6m": 9}, {"default_risk": 1})
    out = policy.simulate_policy(df, policy.CURRENT, policy.CONSERVATIVE).first()
    assert out["defaults_prevented_vs_baseline"] == 0 - 2
    assert out["defaults_prevented_delta"] == -1
    assert out["approvals_lost_vs_baseline"] == -2


def test_no_approvals_divide_by_one(spark):
    out = policy.simulate_policy(applicants(spark, {"enq_L6m": 99}), policy.CONSERVATIVE).first()
    assert (out["n_approved"], out["default_rate_in_approved_pct"], out["expected_loss_cr"]) == (0, 0.0, 0.0)


def test_missing_income_takes_the_median(spark):
    df = applicants(spark, {"NETMONTHLYINCOME": 1000.0}, {"NETMONTHLYINCOME": 3000.0}, {"NETMONTHLYINCOME": None})
    out = policy.simulate_policy(df, policy.CURRENT).first()
    assert out["baseline_el_cr"] == pytest.approx(0.2 * 0.45 * 12 * 6000 / 1e7)


def test_without_income_column_exposure_is_flat(spark):
    out = policy.simulate_policy(applicants(spark, {}).drop("NETMONTHLYINCOME"), policy.CURRENT).first()
    assert out["baseline_el_cr"] == pytest.approx(0.2 * 0.45 * 300000 / 1e7)


def test_approved_and_rejected_add_up(book):
    for r in policy.simulate_policies(book.scored(), policy.PRESETS).collect():
        assert r["n_approved"] + r["n_rejected"] == r["n_total"]
        assert r["defaults_in_approved"] + r["defaults_prevented"] == book.silver().where("default_risk = 1").count()


def test_sliders(spark):
    off = policy.from_sliders(0.9)
    assert off.max_enq_6m is None and off.min_monthly_income is None and off.max_predicted_pd == 0.9
    assert approved(applicants(spark, {"enq_L6m": None, "Age_Oldest_TL": None}), off) == [True]
    on = policy.from_sliders(0.5, max_enq_6m=14, min_monthly_income=1000)
    assert (on.max_enq_6m, on.min_monthly_income) == (14, 1000)
    assert math.isclose(policy.before_and_after(applicants(spark, {"enq_L6m": 20}), on).where(
        "category = 'Rejected'").first()["with_policy"], 1)


def test_missing_income_fails_an_income_floor(book):
    """The simulation approves whom the policy approves: a missing income counts as 0 there."""
    scored = book.scored().withColumn("NETMONTHLYINCOME", F.expr("if(PROSPECTID % 3 = 0, NULL, NETMONTHLYINCOME)"))
    floor = policy.Policy("floor", min_monthly_income=10_000)
    approved = policy.apply_policy(scored, floor).where("approved").count()
    assert policy.simulate_policy(scored, floor).first()["n_approved"] == approved
    assert policy.before_and_after(scored, floor).count() > 0
