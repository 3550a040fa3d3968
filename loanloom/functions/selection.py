"""Exact order statistics by radix selection: no value is ever shuffled, only counts of bit prefixes.

A double becomes a whole number of the same order. A pass counts the next ``DIGIT`` bits of the numbers
that share their leading bits with a wanted rank; counts are added up before the shuffle, at most
65,536 a column, group and rank. Four passes fix all 64 bits. All columns, groups and shares go
through the same passes of one lazy plan, and heavy values or groups cost no more than others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGIT, WIDTH = 16, 64
FRACTION, BIAS = 52, 1023


def _power(exponent: Column) -> Column:
    return F.pow(F.lit(2.0), exponent.cast("double"))


def ordered_bits(df: DataFrame, column: str, output: str) -> DataFrame:
    """Add a whole number per double: larger for larger values, equal for equal ones; zeros are equal, NaN is the largest.

    It is the value's own bit pattern, put together from exponent and fraction; negative for negative values.
    """
    size, step, base = (f"_{k}_{output}" for k in ("size", "step", "base"))
    x = F.abs(F.col(size))
    least = 2.0 ** (1 - BIAS)
    # the logarithm may miss by one next to a power of two
    near = F.floor(F.log2(x)).cast("int")
    df = df.withColumn(size, F.col(column).cast("double"))
    usual = (x >= least) & (x < float("inf"))
    df = df.withColumn(step, F.when(usual, F.least(F.greatest(near, F.lit(1 - BIAS)), F.lit(BIAS))))
    low = x < _power(F.col(step))
    high = (F.col(step) < BIAS) & (x >= _power(F.least(F.col(step) + 1, F.lit(BIAS))))
    df = df.withColumn(base, F.col(step) - low.cast("int") + high.cast("int"))
    fraction = ((x / _power(F.col(base)) - 1.0) * 2.0 ** FRACTION).cast("long")
    whole = F.shiftleft((F.col(base) + BIAS).cast("long"), FRACTION) + fraction
    tiny = (x * 2.0 ** 537 * 2.0 ** 537).cast("long")
    top = F.lit((2 * BIAS + 1) << FRACTION)
    bits = (F.when(F.isnan(size), top + 1).when(x == float("inf"), top).when(x < least, tiny).otherwise(whole))
    return df.withColumn(output, F.when(F.col(size) < 0, -bits).when(F.col(size).isNotNull(), bits)).drop(size, step, base)


def _prefix(bits: Column, digits: int) -> Column:
    return F.shiftright(bits, WIDTH - DIGIT * digits)


def select_ranks(values: DataFrame, by: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """``by``, ``size``, ``rank`` (twice a share's number, plus one for the upper neighbour) and ``value``.

    ``values`` holds ``by`` and a double ``value``; NULL values do not count. The values at both sides of
    every share's place between first and last are returned.
    """
    by, of = list(by), [f"_by{i}" for i in range(len(by))]
    known = values.where(F.col("value").isNotNull()).select(*[F.col(c).alias(n) for c, n in zip(by, of)],
                                                            F.col("value").cast("double").alias("value"))
    rows = ordered_bits(known, "value", "_bits")

    counted = rows.groupBy(*of, _prefix(F.col("_bits"), 1).alias("_at")).agg(
        F.count("*").alias("_n"), F.max("value").alias("value"))
    size = F.sum("_n").over(Window.partitionBy(*of))
    counted = counted.withColumn("_size", size)
    places = [F.lit(float(s)) * (F.col("_size") - 1) for s in shares]
    wanted = F.array(*[F.struct(F.lit(2 * i + up).alias("rank"), side(p).cast("long").alias("left"))
                       for i, p in enumerate(places) for up, side in enumerate((F.floor, F.ceil))])
    found = _holding(counted.withColumn("_want", wanted), of)
    for digits in range(2, WIDTH // DIGIT + 1):
        # a row per column, group and wanted rank at most
        marks = found.select(*[F.col(c).alias(f"_m{c}") for c in of], F.col("_at").alias("_m_at"), "_want", "_size")
        same = [F.col(c).eqNullSafe(F.col(f"_m{c}")) for c in of]
        inside = rows.join(F.broadcast(marks), [*same, _prefix(F.col("_bits"), digits - 1) == F.col("_m_at")])
        counted = inside.groupBy(*of, F.col("_m_at"), _prefix(F.col("_bits"), digits).alias("_at")).agg(
            F.count("*").alias("_n"), F.max("value").alias("value"), F.any_value("_want").alias("_want"), F.any_value("_size").alias("_size"))
        found = _holding(counted, [*of, "_m_at"])
    return found.select(*[F.col(n).alias(c) for c, n in zip(by, of)], F.col("_size").alias("size"), "value",
                        F.explode("_want.rank").alias("rank"))


def _holding(counted: DataFrame, of: Sequence[str]) -> DataFrame:
    """The prefixes that hold a wanted rank, and the ranks left inside them."""
    before = F.sum("_n").over(Window.partitionBy(*of).orderBy("_at")) - F.col("_n")
    placed = counted.withColumn("_before", before)
    here = F.filter("_want", lambda w: (w["left"] >= F.col("_before")) & (w["left"] < F.col("_before") + F.col("_n")))
    inside = F.transform(here, lambda w: F.struct(w["rank"].alias("rank"), (w["left"] - F.col("_before")).alias("left")))
    return placed.withColumn("_want", inside).where(F.size("_want") > 0)


def quantiles(values: DataFrame, by: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: ``by`` and ``q0, q1, ...``, a row per group with values."""
    picked = select_ranks(values, by, shares)

    def at(rank: int) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col("value")))

    def place(share: float) -> Column:
        p = F.lit(float(share)) * (F.max("size") - 1)
        return p - F.floor(p)

    def between(i: int, share: float) -> Column:
        low, high = at(2 * i), at(2 * i + 1)
        return F.when(low == high, low).otherwise(low + place(share) * (high - low))

    return picked.groupBy(*by).agg(*[between(i, s).alias(f"q{i}") for i, s in enumerate(shares)])
