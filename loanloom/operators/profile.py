"""Looking at unknown data: source summaries, column profiles, group statistics, search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions.columns import percent, unpivot_rows
from loanloom.functions.ordered import column_quantiles
from loanloom.functions.text import any_matches

SAMPLE_LENGTH = 40


def source_summary(df: DataFrame, key: str, measures: Sequence[str]) -> DataFrame:
    """Row count, distinct and duplicate keys, and range and mean of the named columns."""
    per_key = df.groupBy(key).agg(
        F.count("*").alias("_n"),
        *[x.alias(f"_{n}_{c}") for c in measures for n, x in
          (("min", F.min(c)), ("max", F.max(c)), ("sum", F.sum(F.col(c).cast("double"))), ("cnt", F.count(c)))])
    return per_key.agg(
        F.sum("_n").alias("row_count"), F.count("*").alias("distinct_keys"),
        F.min(key).alias("min_key"), F.max(key).alias("max_key"),
        F.sum(F.col("_n") - 1).alias("duplicate_keys"),
        *[x.alias(n) for c in measures for n, x in
          ((f"min_{c}", F.min(f"_min_{c}")), (f"max_{c}", F.max(f"_max_{c}")),
           (f"mean_{c}", F.sum(f"_sum_{c}") / F.nullif(F.sum(f"_cnt_{c}").cast("double"), F.lit(0.0))))])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return (df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
            .orderBy(F.desc("count"), column))


def column_profile(df: DataFrame) -> DataFrame:
    """Type, share of NULLs and a shortened sample value of every column, in one pass."""
    types = dict(df.dtypes)
    seen = df.agg(F.count("*").alias("_rows"),
                  *[F.count_if(F.col(c).isNull()).alias(f"_gaps_{i}") for i, c in enumerate(df.columns)],
                  *[F.first(F.col(c).cast("string"), ignorenulls=True).alias(f"_one_{i}")
                    for i, c in enumerate(df.columns)])

    def short(sample):
        cut_off = F.concat(F.substring(sample, 1, SAMPLE_LENGTH), F.lit("..."))
        return F.coalesce(F.when(F.length(sample) > SAMPLE_LENGTH, cut_off).otherwise(sample), F.lit("N/A"))

    rows = [(F.lit(c), F.lit(types[c]), percent(F.col(f"_gaps_{i}"), F.col("_rows")), short(F.col(f"_one_{i}")))
            for i, c in enumerate(df.columns)]
    return unpivot_rows(seen, ("column_name", "data_type", "null_pct", "sample_value"), rows)


def preview(df: DataFrame, rows: int = 3) -> DataFrame:
    return df.limit(rows)


def describe_all(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Per group and column: count, mean, deviation, range and exact quartiles, all columns in one plan."""
    known = df.where(F.col(group).isNotNull())
    long = known.select(group, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])))
    value = F.col("value")
    basics = long.groupBy(group, "column_name").agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    quartiles = column_quantiles(known, columns, [0.25, 0.5, 0.75], by=[group])
    return basics.join(quartiles.withColumnsRenamed({"q0": "q25", "q1": "median", "q2": "q75"}), [group, "column_name"], "left")


def describe_by(df: DataFrame, group: str, column: str) -> DataFrame:
    """Count, mean, deviation, range and exact quartiles of a column per group."""
    return describe_all(df, group, [column]).drop("column_name")


def means_by(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(
        *[F.avg(c).alias(f"avg_{c}") for c in columns])


def compare_groups(df: DataFrame, group: str, first: str, second: str,
                   columns: Sequence[str]) -> DataFrame:
    """Mean of each column in two groups side by side, one scan."""
    sides = (("first", first), ("second", second))
    seen = df.where(F.col(group).isin(first, second)).agg(
        *[F.avg(F.when(F.col(group) == v, F.col(c))).alias(f"{n}_{c}") for c in columns for n, v in sides])
    rows = [(F.lit(c), F.col(f"first_{c}"), F.col(f"second_{c}")) for c in columns]
    return unpivot_rows(seen, ("measure", f"mean_{first}", f"mean_{second}"), rows)


def search(df: DataFrame, pattern: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows in which any column, read as text, matches the pattern in any case."""
    return df.where(any_matches(columns or df.columns, pattern))


def score_by_grade(df: DataFrame) -> DataFrame:
    """Mean bureau score per grade; shows which grades are the risky ones."""
    return means_by(df, "Approved_Flag", [K.SCORE_FEATURE])
