"""Random draws that depend on a key alone, and exact shares of every class by them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# a draw has 60 bits; its leading 16 tell the range it falls into
DIGITS, BITS, RANGE_BITS = 15, 60, 16


def draw(key: Column, salt: int | str) -> Column:
    """A number of 60 bits from the MD5 digest of ``salt:key``; a NULL key counts as empty text."""
    text = F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def exact_parts(df: DataFrame, by: str, key: str, shares: Sequence[float], salt: int | str) -> Column:
    """Number of a row's part: part ``i`` of every class ends after ``shares[i]`` of its rows, rounded half up.

    Rows are taken in the order of their draw. Where the limits lie is found without sorting all
    rows: counts of ranges of draws say in which range the wanted row is, and only the rows of that
    range (one of 65,536) are ordered. Rows with the same key stay together. The limits, one a class
    and share, are found here; the column compares with them.
    """
    drawn = df.select(F.col(by).alias("_class"), F.col(key).alias("_key"), draw(F.col(key), salt).alias("_draw")).withColumn(
        "_range", F.shiftright("_draw", BITS - RANGE_BITS))
    counts = drawn.groupBy("_class", "_range").agg(F.count("*").alias("_n"))
    of_class = Window.partitionBy("_class")
    placed = counts.select("_class", "_range", (F.sum("_n").over(of_class.orderBy("_range")) - F.col("_n")).alias("_before"),
                           "_n", F.sum("_n").over(of_class).alias("_total"))
    wanted = F.array(*[F.struct(F.lit(i).alias("_share"), F.floor(F.col("_total") * F.lit(float(s)) + 0.5).alias("_place"))
                       for i, s in enumerate(shares)])
    limits = (placed.select("_class", "_range", "_before", "_n", F.inline(wanted))
              .where((F.col("_place") > F.col("_before")) & (F.col("_place") <= F.col("_before") + F.col("_n"))))
    # a row per class and share
    inside = drawn.withColumnRenamed("_class", "_of").join(
        F.broadcast(limits.withColumnRenamed("_range", "_in")),
        F.col("_of").eqNullSafe(F.col("_class")) & (F.col("_range") == F.col("_in")))
    order = Window.partitionBy("_class", "_share").orderBy("_draw", "_key")
    found = inside.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") == F.col("_place") - F.col("_before"))
    cuts: dict[object, dict[int, tuple]] = {}
    for row in found.select("_class", "_share", "_draw", "_key").collect():
        cuts.setdefault(row["_class"], {})[row["_share"]] = (row["_draw"], row["_key"])

    own = draw(F.col(key), salt)

    def beyond(limit: tuple | None) -> Column:
        if limit is None:  # a share of no row
            return F.lit(1)
        return F.when((own > limit[0]) | ((own == limit[0]) & F.coalesce(F.col(key) > F.lit(limit[1]), F.lit(False))), 1).otherwise(0)

    part = F.lit(len(shares))
    for value, limits_of in cuts.items():
        number = sum((beyond(limits_of.get(i)) for i in range(len(shares))), F.lit(0))
        part = F.when(F.col(by).eqNullSafe(F.lit(value)), number).otherwise(part)
    return part.cast("int")
