"""Incomplete beta and p-values against closed forms and numeric integration."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions import special
from loanloom.operators import stats


def incomplete_beta(x, a, b, steps=400001):
    """Closed for b = 1, else by integration of a density that has no pole."""
    if b == 1.0:
        return x ** a
    t = np.linspace(0.0, 1.0, steps)
    density = t ** (a - 1) * (1 - t) ** (b - 1)
    sums = np.concatenate(([0.0], np.cumsum((density[1:] + density[:-1]) / 2)))
    return np.interp(x, t, sums / sums[-1])


def test_log_gamma(spark):
    values = [0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 123.4, 1e6]
    rows = spark.createDataFrame([(v,) for v in values], "z double").select("z", special.log_gamma(F.col("z")).alias("g")).collect()
    for r in rows:
        assert r["g"] == pytest.approx(math.lgamma(r["z"]), rel=1e-13, abs=1e-13)


def test_log_beta_of_very_different_arguments(spark):
    rows = spark.createDataFrame([(a, b) for a in (0.5, 3.0, 5e8) for b in (0.5, 40.0)], "a double, b double").select(
        "a", "b", special.log_beta(F.col("a"), F.col("b")).alias("l")).collect()
    for r in rows:
        a, b = r["a"], r["b"]
        want = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b) if a < 1e6 else math.lgamma(b) - b * math.log(a) - b * (b - 1) / (2 * a)
        assert r["l"] == pytest.approx(want, rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("a, b", [(0.5, 1.0), (2.0, 3.0), (7.5, 1.5), (30.0, 12.0), (1.0, 80.0)])
def test_incomplete_beta(spark, a, b):
    xs = [0.0, 1e-6, 0.1, 0.3, 0.5, 0.72, 0.9, 0.999, 1.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    found = special.with_incomplete_beta(df, "i", F.col("x"), 1 - F.col("x"), F.lit(a), F.lit(b)).collect()
    for r in found:
        assert r["i"] == pytest.approx(incomplete_beta(r["x"], a, b), abs=3e-6)
    assert found[0]["i"] == 0.0 and found[-1]["i"] == 1.0


def test_student_p_values(spark):
    cases = [(t, n) for t in (0.0, 1e-9, 0.3, 1.0, 1.96, 4.0, 12.0) for n in (1.0, 2.0, 4.0, 1e9)]
    df = spark.createDataFrame(cases, "t double, n double")
    for r in special.with_t_p_value(df, "p", F.col("t"), F.col("n")).collect():
        t, n = r["t"], r["n"]
        want = {1.0: 1 - 2 / math.pi * math.atan(t), 2.0: 1 - t / math.sqrt(2 + t * t),
                4.0: 1 - t / math.sqrt(4 + t * t) * (1 + 2 / (4 + t * t)), 1e9: math.erfc(t / math.sqrt(2))}[n]
        assert r["p"] == pytest.approx(want, rel=1e-6, abs=1e-14)


def test_arguments_out_of_range_are_null(spark):
    df = spark.createDataFrame([(None, 1.0), (2.0, 1.0), (0.5, -1.0), (float("nan"), 1.0)], "x double, a double")
    found = special.with_incomplete_beta(df, "i", F.col("x"), 1 - F.col("x"), F.col("a"), F.lit(1.0)).collect()
    assert [r["i"] for r in found[:3]] == [None] * 3


def test_p_values_of_gaps_constants_and_perfect_signals(spark):
    rows = [(float(i % 2), None if i % 3 else float(i % 4), 1.0, float(i % 2), None) for i in range(60)]
    df = spark.createDataFrame(rows, f"{K.TARGET} double, gappy double, constant double, perfect double, empty double")
    told = {r["feature"]: r for r in stats.group_p_values(df, ["gappy", "constant", "perfect", "empty"], K.TARGET).collect()}
    complete = df.where("gappy is not null")
    alone = stats.group_p_values(complete, ["gappy"], K.TARGET).first()
    assert told["gappy"]["p_value"] == alone["p_value"] and 0 < alone["p_value"] < 1
    for name in ("constant", "empty"):
        assert (told[name]["p_value"], told[name]["f_value"], told[name]["significant"]) == (None, None, False)
    assert told["perfect"]["p_value"] == 0.0 and told["perfect"]["f_value"] == float("inf") and told["perfect"]["significant"]


def test_p_values_take_one_scan_and_no_python(book):
    plan = stats.signal_p_values(book.gold("fact_credit_risk"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Python" not in plan
