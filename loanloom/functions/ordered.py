"""Order statistics over whole tables without a single-partition window.

Rows are first collapsed to one per distinct value. The distinct values are split
into ranges, each range is cumulated on its own, and range totals (one row per
range) give the starting point of every range. Range limits are fixed numbers by
the time the plan is built, so a task that is run again lands in the same range.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom.functions.columns import fixed_rows
from loanloom.functions.selection import quantiles

_RANGE = "_range"
RANGES_PER_PARTITION = 2
MAX_RANGES = 8000


class Ranges(NamedTuple):
    """Limits of value ranges, and the values that fill more than one range on their own."""

    limits: list[float]
    hot: dict[float, int]


def value_ranges(rows: DataFrame, column: str, ranges: int | None = None) -> Ranges:
    """Cut a column into ranges of about as many rows each.

    One narrow scan into a sketch of bounded size. A range holds no more distinct values
    than rows, so hot values cannot make a range too large. A limit that repeats is a hot
    value; it fills about as many ranges as it repeats. Results never depend on how exact
    the sketch is, only the balance of the work does.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or min(MAX_RANGES, max(2, RANGES_PER_PARTITION * partitions))
    shares = [i / ranges for i in range(1, ranges)]
    sketch = F.percentile_approx(F.col(column).cast("double"), shares, max(10_000, 5 * ranges))
    found = rows.select(sketch.alias("limits")).first()["limits"] or []
    times = Counter(float(x) for x in found if math.isfinite(x))
    return Ranges(sorted(times), {value: n for value, n in times.items() if n > 1})


def range_limits(rows: DataFrame, column: str, ranges: int | None = None) -> list[float]:
    return value_ranges(rows, column, ranges).limits


def _with_range(df: DataFrame, key: str, limits: Sequence[float]) -> DataFrame:
    """Index of the range a value falls in; equal values share a range."""
    if not limits:
        return df.withColumn(_RANGE, F.lit(0.0))
    return Bucketizer(splits=[-math.inf, *limits, math.inf], inputCol=key, outputCol=_RANGE,
                      handleInvalid="keep").transform(df)


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Equal keys, NULL equal to NULL; plain equality where NULL cannot occur."""
    def pair(name):
        a, b = F.col(f"l.{name}"), F.col(f"r.{name}")
        nullable = left.schema[name].nullable and right.schema[name].nullable and name != _RANGE
        return a.eqNullSafe(b) if nullable else a == b

    return reduce(and_, [pair(n) for n in names])


def running_totals(df: DataFrame, key: str, values: Sequence[str], *, by: Sequence[str] = (),
                   descending: bool = False, limits: Sequence[float] | None = None) -> DataFrame:
    """Add ``<value>_before``: the sum over all rows that come before this one.

    ``df`` holds one row per ``by`` and ``key``. Without ``limits`` the keys of a group
    must be few (a score scale, a grid): one plain window per group serves them.
    """
    by = list(by)
    step = F.col(key).desc() if descending else F.col(key).asc()

    def before(window):
        return {f"{v}_before": F.coalesce(F.sum(v).over(window), F.lit(0)) for v in values}

    if limits is None:
        window = Window.partitionBy(*by).orderBy(step)
        return df.withColumns(before(window.rowsBetween(Window.unboundedPreceding, -1)))

    split = _with_range(df, key, limits)
    inside = Window.partitionBy(*by, _RANGE).orderBy(step)
    local = split.withColumns(before(inside.rowsBetween(Window.unboundedPreceding, -1)))
    range_step = F.col(_RANGE).desc() if descending else F.col(_RANGE).asc()
    across = Window.partitionBy(*by).orderBy(range_step)
    starts = (split.groupBy(*by, _RANGE).agg(*[F.sum(v).alias(v) for v in values])
              .select(*by, _RANGE,
                      *[c.alias(f"_start_{n}") for n, c in
                        before(across.rowsBetween(Window.unboundedPreceding, -1)).items()]))
    joined = local.alias("l").join(starts.alias("r"), _same(local, starts, [*by, _RANGE]))
    added = [f"{v}_before" for v in values]
    keep = [F.col(f"l.{c}") for c in local.columns if c not in added and c != _RANGE]
    return joined.select(*keep, *[(F.col(f"l.{n}") + F.col(f"r._start_{n}")).alias(n) for n in added])


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float], *,
                    by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, one column ``q<i>`` per share."""
    return quantiles(df.select(*by, F.col(column).alias("value")), by, shares)


def column_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], *, by: Sequence[str] = ()) -> DataFrame:
    """The same for several columns in one plan: ``by``, ``column_name`` and the quantiles."""
    long = df.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value"))
                                             for c in columns])))
    return quantiles(long, [*by, "column_name"], shares)


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median of each column, as plain numbers; all columns share one job."""
    found = {row["column_name"]: row["q0"] for row in column_quantiles(df, columns, [0.5]).collect()}
    return {c: found.get(c) for c in columns}


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace NULL (and NaN) by the column's exact median.

    One narrow pass counts the gaps first; only columns that have any pay for a median.
    """
    def known(c):
        return F.nullif(F.col(c).cast("double"), F.lit(float("nan")))

    gaps = df.agg(*[F.count_if(known(c).isNull()).alias(c) for c in columns]).first()
    holes = [c for c in columns if gaps[c]]
    if not holes:
        return df
    middle = medians(df.select(*[known(c).alias(c) for c in holes]), holes)
    return df.withColumns({c: F.coalesce(known(c), F.lit(middle[c]).cast("double")) for c in holes})


def _with_looked_up_rank(df: DataFrame, source: DataFrame, column: str, output: str,
                         spread_by: str) -> DataFrame:
    rows = source.where(F.col(column).isNotNull()).select(F.col(column).alias("_v"))
    ranges = value_ranges(rows, "_v")
    values = rows.distinct().withColumn("_one", F.lit(1))
    ranked = (running_totals(values, "_v", ["_one"], descending=True, limits=ranges.limits)
              .select("_v", (F.col("_one_before") + 1).cast("long").alias(output)))

    def with_copies(frame: DataFrame, value: str) -> DataFrame:
        if not ranges.hot:
            return frame.withColumn("_copies", F.lit(1))
        hot = fixed_rows(df.sparkSession, "_hot double, _n int", list(ranges.hot.items()))
        return (frame.join(F.broadcast(hot), F.col(value).cast("double") == F.col("_hot"), "left")
                .withColumn("_copies", F.coalesce("_n", F.lit(1))).drop("_hot", "_n"))

    copied = (with_copies(ranked, "_v")
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies"))
    spread = F.when(F.col(column).isNull(), F.lit(len(ranges.limits) + 1)).otherwise(F.col("_copies"))
    salted = (with_copies(df, column)
              .withColumn("_salt", F.pmod(F.xxhash64(spread_by), spread).cast("int")).drop("_copies"))
    return (salted.alias("r")
            .join(copied.alias("k"), (F.col(f"r.{column}") == F.col("k._v"))
                  & (F.col("r._salt") == F.col("k._salt")), "left")
            .select("r.*", f"k.{output}").drop("_salt"))


def dense_ranks_desc(df: DataFrame, outputs: Mapping[str, str], spread_by: str) -> DataFrame:
    """Dense rank of every row by each column, 1 = largest value; NULL gets no rank.

    ``outputs`` maps a column to the name of its rank. Ranks are computed on distinct
    values and joined back. The rank row of a hot value is copied and its rows are spread
    over the copies; rows without a value are spread as well. The list of hot values is
    shorter than half the number of ranges, so it is safe to broadcast.
    """
    ranked = df
    for column, output in outputs.items():
        ranked = _with_looked_up_rank(ranked, df, column, output, spread_by)
    return ranked
