"""Radix selection against sorting."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanloom.functions import selection

ODD = [0.0, -0.0, 1.0, -1.0, 2.0, 0.5, 4.9e-324, -4.9e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308,
       -1.7976931348623157e308, math.inf, -math.inf, 3.0000000000000004, 1 - 2 ** -53, 8.0, 7.999999999999999, 1e-300, 1e300, 1024.0]


def pattern(x):
    bits = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -bits if x < 0 else bits


def test_bits_are_the_pattern_of_the_value(spark):
    rng = random.Random(2)
    values = ODD + [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(3000)]
    values = [v for v in values if not math.isnan(v)] + [2.0 ** e for e in range(-1074, 1024)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = selection.ordered_bits(df, "x", "b").collect()
    assert all(r["b"] == pattern(r["x"]) for r in found) and len(found) == len(values)
    assert found[0].asDict().keys() == {"x", "b"}
    nan = selection.ordered_bits(spark.createDataFrame([(math.nan,), (None,)], "x double"), "x", "b").collect()
    assert nan[0]["b"] == pattern(math.inf) + 1 and nan[1]["b"] is None


@pytest.mark.parametrize("shares", [[0.5], [0.0, 0.25, 0.5, 0.75, 1.0], [0.999]])
def test_quantiles_equal_sorting(spark, shares):
    rng = np.random.default_rng(4)
    groups = {"normal": rng.normal(size=501), "one": np.array([3.25]), "equal": np.full(400, -7.5), "two": np.array([1.0, 2.0]),
              "hot": np.concatenate([np.full(900, 1e9), rng.normal(size=100) * 1e12]), "whole": rng.integers(-50, 50, 333).astype(float),
              None: rng.random(64)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("one", None), ("empty", None)]
    found = selection.quantiles(spark.createDataFrame(rows, "g string, value double").repartition(5), ["g"], shares).collect()
    assert {r["g"] for r in found} == set(groups)
    for r in found:
        want = np.quantile(groups[r["g"]], shares)
        assert [r[f"q{i}"] for i in range(len(shares))] == pytest.approx(list(want), rel=1e-12)


def test_infinite_values(spark):
    rows = [(v,) for v in (-math.inf, -math.inf, 1.0, math.inf, math.inf)]
    row = selection.quantiles(spark.createDataFrame(rows, "value double"), [], [0.25, 0.5, 0.9]).first()
    assert tuple(row) == (-math.inf, 1.0, math.inf)


def test_no_values(spark):
    assert selection.quantiles(spark.createDataFrame([], "g int, value double"), ["g"], [0.5]).count() == 0


def test_only_counts_are_shuffled(book):
    """One lazy plan; every exchange but the broadcasts is above an aggregate of counts."""
    from loanloom.operators import profile
    plan = profile.describe_all(book.silver(), "Approved_Flag", ["Credit_Score", "AGE"])._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    for line, below in zip(lines, lines[1:]):
        if "Exchange hashpartitioning" in line:
            assert "Aggregate" in below or "Window" in below or "Project" in below, below
    assert "Scan ExistingRDD" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
