"""Bands, small expressions and order statistics on hand-made tables and against brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions import bands, columns, ordered, rounding, text


def values(df, column="out"):
    return [row[column] for row in df.collect()]


def frame(spark, numbers, name="x", kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(numbers)], f"i int, {name} {kind}").orderBy("i")


@pytest.mark.parametrize("right", [True, False])
def test_cut_agrees_with_pandas(spark, right):
    edges, labels = [0, 10, 20, 30], ["a", "b", "c"]
    numbers = [-1.0, 0.0, 0.1, 9.99, 10.0, 10.01, 20.0, 29.9, 30.0, 30.1, None]
    expected = pd.cut(pd.Series(numbers, dtype=float), bins=edges, labels=labels, right=right)
    got = values(frame(spark, numbers).select(bands.cut(F.col("x"), edges, labels, right=right).alias("out")))
    assert got == [None if pd.isna(v) else v for v in expected]


def test_cut_with_open_ends(spark):
    numbers = [float("-inf"), -1e9, 0.25, 0.26, 0.5, 1.0, float("inf"), float("nan"), None]
    out = values(frame(spark, numbers).select(
        bands.cut(F.col("x"), *K.EXPORT_PD_BAND, fill="Unknown").alias("out")))
    assert out == ["Unknown", "Low Risk", "Low Risk", "Medium Risk", "Medium Risk", "High Risk", "High Risk",
                   "Unknown", "Unknown"]


def test_income_and_score_edges(spark):
    income = values(frame(spark, [0.0, 15000.0, 15000.01, 100000.0, 100000.01, None]).select(
        bands.income_tier(F.col("x")).alias("out")))
    assert income == ["nan", "very_low", "low", "upper_middle", "high", "nan"]
    score = values(frame(spark, [549, 550, 649, 650, 900, 901], kind="int").select(
        bands.score_band(F.col("x")).alias("out")))
    assert score == ["poor", "fair", "fair", "good", "excellent", "nan"]


def test_probability_band_edges(spark):
    out = values(frame(spark, [0.0, 0.2499, 0.25, 0.5, 0.9999, 1.0]).select(bands.pd_band(F.col("x")).alias("out")))
    assert out == ["Low Risk", "Low Risk", "Medium Risk", "High Risk", "High Risk", None]


def test_score_steps(spark):
    df = frame(spark, [299, 300, 319, 320, 799, 800, None], kind="int")
    assert values(df.select(bands.score_step_start(F.col("x")).alias("out"))) == [
        None, 300, 300, 320, 780, None, None]
    assert values(df.where("x = 799").select(
        bands.score_step_label(bands.score_step_start(F.col("x"))).alias("out"))) == ["780-799"]


def test_report_labels_swallow_the_rest(spark):
    df = frame(spark, [0, 1, 3, 5, 6, -99999, None], kind="int")
    assert values(df.select(bands.enquiry_label(F.col("x")).alias("out"))) == [
        "0 enquiries", "1 enquiry", "3 enquiries", "4-5 enquiries"] + ["6+ enquiries"] * 3
    ages = frame(spark, [17, 18, 25, 26, 55, 56, None], kind="int")
    assert values(ages.select(bands.age_segment(F.col("x")).alias("out"))) == [
        "55+", "18-25", "18-25", "26-35", "46-55", "55+", "55+"]
    gap = frame(spark, [19999.0, 19999.5, 20000.0])
    assert values(gap.select(bands.income_label(F.col("x")).alias("out"))) == [
        "2. 10-20k", "5. 60k+", "3. 20-35k"]
    assert values(frame(spark, [24, 25, 54, 55, None], kind="int").select(
        bands.gold_age_band(F.col("x")).alias("out"))) == ["under_25", "25_to_34", "45_to_54", "55_plus", "55_plus"]


def test_guards(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, -1.0), (1.0, None), (None, 2.0)], "n double, d double")
    assert values(df.select(columns.guarded_ratio(F.col("n"), F.col("d")).alias("out"))) == [0.5, 0.0, 0.0, 0.0, None]
    assert values(df.select(columns.ratio_or_null(F.col("n"), F.col("d")).alias("out"))) == [0.5, None, -1.0, None, None]


def test_finite_or_zero_and_numbers_from_text(spark):
    df = frame(spark, [1.5, float("inf"), float("-inf"), float("nan"), None])
    assert values(df.select(columns.finite_or_zero(F.col("x")).alias("out"))) == [1.5, 0.0, 0.0, 0.0, 0.0]
    worded = spark.createDataFrame([("12",), ("1e2",), ("abc",), (None,)], "x string")
    assert values(columns.to_number(worded, ["x", "absent"]), "x") == [12.0, 100.0, None, None]
    assert columns.with_missing_as_zero(worded, ["x", "y"]).select("y").distinct().collect()[0]["y"] == 0.0


def test_text_rules(spark):
    df = spark.createDataFrame([(" mARried ",), ("post-graduate",), (None,), ("o'neil x",)], "x string")
    shown = df.select(text.title_case(text.present_text(F.col("x"))).alias("out"))
    assert values(shown) == [(v or "nan").strip().title() for v in (" mARried ", "post-graduate", None, "o'neil x")]
    found = spark.createDataFrame([("a", 1), ("Approved", 2), (None, 3), ("p3 x", 4)], "x string, n int").where(
        text.any_matches(["x", "n"], "approved|P3"))
    assert sorted(values(found, "n")) == [2, 4]


def test_rounding_modes(spark):
    df = frame(spark, [0.125, 2.5, -0.0000001])
    assert values(rounding.present(df, {"x": 0, "absent": 1}), "x")[1] == 3.0
    assert values(rounding.present(df, {"x": 0}, half_even=True), "x")[1] == 2.0
    assert [math.copysign(1, v) for v in values(rounding.settle(df), "x")][2] == 1.0


def test_schema_walks(spark):
    df = spark.createDataFrame([(1, True, "a", 2.0)], "n int, b boolean, s string, d double")
    assert columns.numeric_columns(df, ["n"]) == ["d"]
    assert dict(columns.booleans_to_int(df).dtypes)["b"] == "int"
    assert columns.first_present(df, ["zz", "s"]) == "s" and columns.first_present(df, ["zz"]) is None


def heavy_numbers(n=3000, seed=1):
    """A third of all rows on one value, long tail, some gaps."""
    rng = random.Random(seed)
    return [7.25 if i % 3 == 0 else None if i % 97 == 0 else round(rng.lognormvariate(3, 2), 2) for i in range(n)]


@pytest.mark.parametrize("numbers", [heavy_numbers(), [5.0] * 50, [1.0], [float(i) for i in range(500)], [-3.5, 0.0, None, 2.0]])
def test_dense_rank(spark, numbers):
    df = frame(spark, numbers).repartition(5)
    expected = pd.Series(numbers, dtype=float).rank(method="dense", ascending=False)
    got = {r["i"]: r["rank"] for r in ordered.dense_ranks_desc(df, {"x": "rank"}, "i").collect()}
    assert len(got) == len(numbers)
    assert all((pd.isna(e) and got[i] is None) or got[i] == e for i, e in enumerate(expected))


def test_quantiles_by_group(spark):
    numbers = heavy_numbers()
    rows = [("a" if i % 4 else None, v) for i, v in enumerate(numbers)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    got = {r["g"]: r for r in ordered.exact_quantiles(df, "x", [0.1, 0.5, 0.75], by=["g"]).collect()}
    for group in ("a", None):
        known = [v for g, v in rows if g == group and v is not None]
        assert [got[group][f"q{i}"] for i in range(3)] == pytest.approx(list(np.quantile(known, [0.1, 0.5, 0.75])))


@pytest.mark.parametrize("limits", [None, [2.0, 5.0], []])
@pytest.mark.parametrize("descending", [True, False])
def test_running_totals(spark, limits, descending):
    rows = [(g, float(k), k + 1) for g in ("x", "y") for k in range(8)]
    df = spark.createDataFrame(rows, "g string, k double, n long")
    got = ordered.running_totals(df, "k", ["n"], by=["g"], descending=descending, limits=limits).collect()
    assert len(got) == len(rows)
    for r in got:
        before = [n for g, k, n in rows if g == r["g"] and (k > r["k"] if descending else k < r["k"])]
        assert r["n_before"] == sum(before)


def test_median_fill(spark):
    df = spark.createDataFrame([(1, 10.0, 1), (2, None, 2), (3, 30.0, 3), (4, float("nan"), 4)], "k int, x double, full int")
    filled = ordered.fill_median(df, ["x", "full"])
    assert {r["k"]: r["x"] for r in filled.collect()} == {1: 10.0, 2: 20.0, 3: 30.0, 4: 20.0}
    assert dict(filled.dtypes)["full"] == "int"
