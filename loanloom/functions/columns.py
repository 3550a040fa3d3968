"""Small column expressions shared by the operators, and plan-time column selection."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """``n / d``, and 0 when the divisor is NULL, zero or negative."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def ratio_or_null(numerator: Column, denominator: Column) -> Column:
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def percent(numerator: Column, denominator: Column) -> Column:
    return numerator.cast("double") * F.lit(100.0) / F.nullif(denominator.cast("double"), F.lit(0.0))


def at_least_zero(column: Column) -> Column:
    return F.greatest(column, F.lit(0.0))


def flag(condition: Column) -> Column:
    """0/1 with NULL conditions counted as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def holds(condition: Column) -> Column:
    """A comparison with NULL does not hold."""
    return F.coalesce(condition, F.lit(False))


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def mean_where(value: Column, condition: Column) -> Column:
    return F.avg(F.when(condition, value))


def total(columns: Iterable[Column]) -> Column:
    return reduce(add, columns)


def weighted_sum(weights: Mapping[str, float]) -> Column:
    return total(F.col(name) * F.lit(weight) for name, weight in weights.items())


def mapped(column: Column, values: Mapping[str, object], default=None) -> Column:
    """Look a value up in a small fixed vocabulary."""
    pairs = [F.lit(part) for item in values.items() for part in item]
    found = F.create_map(*pairs)[column]
    return found if default is None else F.coalesce(found, F.lit(default))


def first_present(df: DataFrame, candidates: Sequence[str]) -> str | None:
    return next((name for name in candidates if name in df.columns), None)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def matching_columns(df: DataFrame, patterns: Iterable[str]) -> list[str]:
    wanted = tuple(patterns)
    return [name for name in df.columns if any(p in name.lower() for p in wanted)]


def booleans_to_int(df: DataFrame) -> DataFrame:
    changed = {f.name: F.col(f.name).cast("int") for f in df.schema.fields
               if isinstance(f.dataType, T.BooleanType)}
    return df.withColumns(changed) if changed else df


def with_missing_as_zero(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = {name: F.lit(0.0) for name in required if name not in df.columns}
    return df.withColumns(missing) if missing else df


def to_number(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Read text as numbers, NULL where it is none; numeric columns stay as they are."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    changed = {n: F.col(n).try_cast("double") for n in names if n in text}
    return df.withColumns(changed) if changed else df


def finite_or_zero(column: Column) -> Column:
    """NULL, NaN and infinities become 0."""
    number = column.cast("double")
    broken = F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.coalesce(F.when(~broken, number), F.lit(0.0))


def fixed_rows(spark: SparkSession, schema: str, rows: Sequence[Sequence]) -> DataFrame:
    """A constant list (bands, cut-offs) as a table that the planner knows to be small."""
    fields = T.StructType.fromDDL(schema).fields
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(fields, row)])
               for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def unpivot_rows(df: DataFrame, names: Sequence[str],
                 rows: Sequence[Sequence[Column]]) -> DataFrame:
    """One-row result -> one row per entry, without another scan."""
    entries = [F.struct(*[value.alias(name) for name, value in zip(names, row)]) for row in rows]
    return df.select(F.inline(F.array(*entries)))
