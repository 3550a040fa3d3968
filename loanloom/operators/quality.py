"""Data-quality checks. Each returns rows; none of them stops a pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions.columns import (count_where, mean_where, numeric_columns,
                                        unpivot_rows)

# ---- fixed values: columns that must not hold NULL, limits of the bureau score -----------
REQUIRED = ("PROSPECTID", "Credit_Score", "default_risk", "NETMONTHLYINCOME", "AGE")
SCORE_LIMITS = (300, 900)
EXPORT_BANDS = ("pd_band", "age_band", "income_band", "enquiry_band", "delinquency_band")


def duplicate_keys(df: DataFrame, key: str = K.KEY) -> DataFrame:
    """Rows beyond the first of each key; keys are counted once before the total is taken."""
    return df.groupBy(key).agg(F.count("*").alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_keys"))


def quality_checks(silver: DataFrame) -> DataFrame:
    """One row per check: name, passed, and the number behind it."""
    present = set(silver.columns)
    score, target = F.col("Credit_Score"), F.col(K.TARGET)
    checks: list[tuple[str, Column, callable]] = []

    def none_of(value: Column) -> Column:
        return value == 0

    for name in REQUIRED:
        if name in present:
            checks.append((f"{name}_nulls", count_where(F.col(name).isNull()), none_of))
    if "Credit_Score" in present:
        inside = F.coalesce(score.between(*SCORE_LIMITS), F.lit(False))
        checks.append(("score_out_of_range", count_where(~inside), none_of))
    if K.TARGET in present:
        binary = F.coalesce(target.isin(0, 1), F.lit(False))
        checks.append(("target_not_binary", count_where(~binary), none_of))
    if {"Credit_Score", K.TARGET} <= present:
        gap = mean_where(score, target == 1) - mean_where(score, target == 0)
        checks.append(("risky_minus_safe_score", gap, lambda v: F.coalesce(v < 0, F.lit(False))))
    if "grade_band" in present:
        checks.append(("grade_band_unknown", count_where(F.col("grade_band").isin(*K.UNKNOWN_LABELS)), none_of))
    if "NETMONTHLYINCOME" in present:
        checks.append(("negative_income", count_where(F.col("NETMONTHLYINCOME") < 0), none_of))

    measured = silver.agg(*[measure.cast("double").alias(name) for name, measure, _ in checks])
    rows = [(F.lit(name), verdict(F.col(name)), F.col(name)) for name, _, verdict in checks]
    columns = ("check_name", "passed", "value")
    repeated = duplicate_keys(silver).select(F.col("duplicate_keys").cast("double").alias("v"))
    return unpivot_rows(measured, columns, rows).unionByName(
        repeated.select(F.lit("duplicate_keys").alias("check_name"), (F.col("v") == 0).alias("passed"),
                        F.col("v").alias("value")))


def all_passed(checks: DataFrame) -> DataFrame:
    return checks.agg(F.bool_and("passed").alias("all_passed"))


def encoding_direction(df: DataFrame) -> DataFrame:
    """Mean bureau score of risky and safe borrowers; risky must be lower."""
    score, target = F.col("Credit_Score"), F.col(K.TARGET)
    return (df.agg(mean_where(score, target == 1).alias("risky_mean_score"),
                   mean_where(score, target == 0).alias("safe_mean_score"))
            .withColumn("encoding_ok", F.col("risky_mean_score") < F.col("safe_mean_score")))


def key_reconciliation(left: DataFrame, right: DataFrame, key: str = K.KEY) -> DataFrame:
    """Keys on both sides, on one side only, and a verdict.

    One grouping over both key columns; neither key set is held anywhere as a whole.
    """
    def side(df, in_left):
        return df.select(key, F.lit(in_left).alias("l"), F.lit(not in_left).alias("r"))

    keys = (side(left, True).unionByName(side(right, False)).where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.bool_or("l").alias("l"), F.bool_or("r").alias("r")))
    counted = keys.agg(count_where(F.col("l")).alias("left_keys"), count_where(F.col("r")).alias("right_keys"),
                       count_where(F.col("l") & F.col("r")).alias("matched"),
                       count_where(F.col("l") & ~F.col("r")).alias("only_left"),
                       count_where(~F.col("l") & F.col("r")).alias("only_right"))
    perfect = (F.col("only_left") + F.col("only_right")) == 0
    return counted.withColumn("verdict", F.when(perfect, "perfect")
                              .when(F.col("matched") > 0, "partial").otherwise("none"))


def sentinel_scan(df: DataFrame) -> DataFrame:
    """How many rows of each numeric column hold the not-applicable marker; one pass."""
    names = numeric_columns(df)
    counted = df.agg(*[count_where(F.col(c) == K.NOT_APPLICABLE).alias(c) for c in names])
    rows = [(F.lit(c), F.col(c), F.col(c) > 0) for c in names]
    return unpivot_rows(counted, ("column_name", "marked_rows", "has_marker"), rows)


def blank_bands(export: DataFrame, bands: Sequence[str] = EXPORT_BANDS) -> DataFrame:
    """Per band column: unlabelled rows and the sorted list of labels in use."""
    known = [c for c in bands if c in export.columns]
    per_label = (unpivot_rows(export, ("band_column", "label"), [(F.lit(c), F.col(c)) for c in known])
                 .groupBy("band_column", "label").agg(F.count("*").alias("_n")))
    blank = F.col("label").isNull() | F.col("label").isin(*K.UNKNOWN_LABELS)
    return per_label.groupBy("band_column").agg(
        F.coalesce(F.sum(F.when(blank, F.col("_n"))), F.lit(0)).alias("blank_rows"),
        F.array_join(F.sort_array(F.collect_set("label")), "|").alias("labels"))


def leakage_gate(aucs: DataFrame) -> DataFrame:
    """Features whose lone AUC is too good to be honest."""
    return aucs.where(F.col("leakage_suspected")).select("feature", "auc")
