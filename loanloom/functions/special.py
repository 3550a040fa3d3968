"""Special functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# terms of the continued fraction, and steps that lift an argument to where the asymptotic series holds
TERMS = 400
LIFT = 10
HALF_LOG_TWO_PI = 0.9189385332046727


def _correction(z: Column) -> Column:
    """What Stirling's formula lacks of ln Gamma, for arguments from ``LIFT`` up."""
    w = F.lit(1.0) / (z * z)
    return (F.lit(1 / 12) - w * (F.lit(1 / 360) - w * (F.lit(1 / 1260) - w * (F.lit(1 / 1680) - w * F.lit(1 / 1188))))) / z


def log_gamma(z: Column) -> Column:
    """ln Gamma of a positive number."""
    high = z + F.lit(float(LIFT))
    lifted = sum((F.log(z + F.lit(float(i))) for i in range(LIFT)), F.lit(0.0))
    return (high - 0.5) * F.log(high) - high + F.lit(HALF_LOG_TWO_PI) + _correction(high) - lifted


def log_beta(a: Column, b: Column) -> Column:
    """ln Beta; the larger argument enters by ratios only, so it may be of any size."""
    big, small = F.greatest(a, b), F.least(a, b)
    high = big + F.lit(float(LIFT))
    # ln Gamma(big) - ln Gamma(big + small)
    falls = (F.lit(0.5) - high) * F.log1p(small / high) - small * F.log(high + small) + small + _correction(high) - _correction(high + small)
    return log_gamma(small) + falls + sum((F.log1p(small / (big + F.lit(float(i)))) for i in range(LIFT)), F.lit(0.0))


def with_incomplete_beta(df: DataFrame, name: str, x: Column, rest: Column, a: Column, b: Column) -> DataFrame:
    """Add the regularised incomplete beta function of ``x``; ``rest`` is ``1 - x``, given apart because
    it may be far smaller than the rounding of ``x``.

    The continued fraction is taken from its last term back, on the side of the mean where it
    converges fast. NULL where an argument is NULL or out of range.
    """
    given = {f"_{name}_{k}": v.cast("double") for k, v in zip(("x", "rest", "a", "b"), (x, rest, a, b))}
    df = df.withColumns(given)
    x, rest, a, b = (F.col(c) for c in given)
    valid = (x >= 0) & (rest >= 0) & (a > 0) & (b > 0)
    below = x < (a + 1) / (a + b + 2)
    sides = {f"_{name}_{k}": v for k, v in {
        "below": below, "u": F.when(below, x).otherwise(rest), "v": F.when(below, rest).otherwise(x),
        "p": F.when(below, a).otherwise(b), "q": F.when(below, b).otherwise(a)}.items()}
    df = df.withColumns(sides)
    below, u, v, p, q = (F.col(c) for c in sides)

    def term(k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (q - m) * u / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * u / ((p + 2 * m) * (p + 2 * m + 1))
        return F.when(k % 2 == 0, even).otherwise(odd)

    fraction = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), F.lit(1.0), lambda t, k: F.lit(1.0) + term(k) / t)
    front = F.exp(p * F.when(u < 0.5, F.log(u)).otherwise(F.log1p(-v)) + q * F.when(v < 0.5, F.log(v)).otherwise(F.log1p(-u))
                  - log_beta(p, q)) / p
    side = F.when((u <= 0) | (v <= 0), F.when(u <= 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(front / fraction)
    value = F.when(below, side).otherwise(F.lit(1.0) - side)
    return df.withColumn(name, F.when(valid, value)).drop(*given, *sides)


def with_correlation_p_value(df: DataFrame, name: str, r: Column, freedom: Column) -> DataFrame:
    """Add the two-sided p-value of a correlation: of Student's t, or of F with one degree, alike."""
    square = r * r
    return with_incomplete_beta(df, name, F.lit(1.0) - square, square, freedom / 2, F.lit(0.5))


def with_t_p_value(df: DataFrame, name: str, t: Column, freedom: Column) -> DataFrame:
    """Add the two-sided p-value of Student's t."""
    square, n = t * t, freedom.cast("double")
    return with_incomplete_beta(df, name, n / (n + square), square / (n + square), n / 2, F.lit(0.5))

