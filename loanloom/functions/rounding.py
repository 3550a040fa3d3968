"""Rounding as a final step.

Operators return unrounded numbers. ``settle`` removes the last-digit noise that
sums of fractions pick up from the order in which partitions arrive; ``present``
rounds for display.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def settle(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column; adding 0.0 turns a negative zero into zero."""
    doubles = {f.name: F.round(F.col(f.name), digits) + F.lit(0.0) for f in df.schema.fields
               if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(doubles) if doubles else df


def present(df: DataFrame, digits: Mapping[str, int], half_even: bool = False) -> DataFrame:
    """Round the named columns, half away from zero or half to even."""
    rule = F.bround if half_even else F.round
    known = {name: rule(F.col(name), n) for name, n in digits.items() if name in df.columns}
    return df.withColumns(known) if known else df
