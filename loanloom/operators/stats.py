"""Statistics over the fact table: score bands, inequality, association, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions import bands
from loanloom.functions.columns import mean_where, numeric_columns, unpivot_rows
from loanloom.functions.ordered import range_limits, running_totals
from loanloom.functions.special import with_correlation_p_value

MIN_SIGNAL_ROWS = 100
SIGNIFICANCE = 0.05
NORMAL_QUANTILE = 1.959963984540054


def score_band_table(fact: DataFrame) -> DataFrame:
    """20-point score bands with the change against the band before; scores from 800 drop out."""
    start = bands.score_step_start(F.col("cibil_score"))
    grouped = (fact.groupBy(start.alias("band_start")).agg(
        F.count(K.TARGET).alias("borrowers"), F.sum(F.col(K.TARGET).cast("long")).alias("risky"),
        (F.avg(K.TARGET) * 100).alias("default_rate_pct"),
        F.avg("monthly_income_inr").alias("avg_income"), F.avg("total_loans").alias("avg_loans"))
        .where(F.col("band_start").isNotNull()))
    previous = F.lag("default_rate_pct").over(Window.partitionBy().orderBy("band_start"))
    return (grouped.withColumns({"score_band": bands.score_step_label(F.col("band_start")),
                                 "rate_change": F.col("default_rate_pct") - previous})
            .orderBy("band_start"))


def steepest_band(band_table: DataFrame) -> DataFrame:
    """The band with the largest drop; the first of equals, bands without a change ignored."""
    changed = band_table.where(F.col("rate_change").isNotNull())
    best = F.min_by(F.struct("score_band", "rate_change"), F.struct("rate_change", "band_start"))
    return changed.agg(best.alias("b")).select("b.*")


def gini(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Gini coefficient of a column, per group if asked.

    Equal values are counted once: a value with ``c`` rows after ``b`` smaller ones adds
    ``v * (c*b + c*(c+1)/2)`` to the weighted sum.
    """
    by = list(by)
    rows = df.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("v"))
    counts = rows.groupBy(*by, "v").agg(F.count("*").alias("c"))
    placed = running_totals(counts, "v", ["c"], by=by, limits=range_limits(rows, "v"))
    c, b, v = F.col("c").cast("double"), F.col("c_before").cast("double"), F.col("v")
    sums = placed.groupBy(*by).agg(
        F.sum(v * (c * b + c * (c + 1.0) / 2.0)).alias("w"), F.sum(v * c).alias("s"),
        F.sum("c").alias("n_borrowers"))
    n = F.col("n_borrowers").cast("double")
    value = F.lit(2.0) * F.col("w") / F.nullif(n * F.col("s"), F.lit(0.0)) - (n + 1.0) / n
    return sums.select(*by, "n_borrowers", value.alias("gini"))


def gini_overall(fact: DataFrame) -> DataFrame:
    """Inequality of bureau scores."""
    return gini(fact, "cibil_score")


def gini_by_tier(fact: DataFrame, min_rows: int = 10) -> DataFrame:
    """Per income tier with more than ``min_rows`` borrowers, with mean score and default rate."""
    unequal = gini(fact, "cibil_score", ["income_tier"])
    profile = fact.groupBy("income_tier").agg(
        F.count("*").alias("n_borrowers"), F.avg("cibil_score").alias("avg_cibil"),
        (F.avg(K.TARGET) * 100).alias("default_rate_pct"))
    return (profile.where(F.col("n_borrowers") > min_rows)
            .join(unequal.select("income_tier", F.col("gini").alias("gini_score")), "income_tier"))


def risky_vs_safe(fact: DataFrame, columns: Sequence[str] = K.RISKY_SAFE_COLUMNS) -> DataFrame:
    """Means of both classes, their difference and the difference in percent; one pass."""
    names = [c for c in columns if c in fact.columns]
    target = F.col(K.TARGET)
    seen = fact.agg(*[mean_where(F.col(c), target == side).alias(f"{c}_{side}")
                      for c in names for side in (0, 1)])
    rows = []
    for c in names:
        risky, safe = F.col(f"{c}_1"), F.col(f"{c}_0")
        rows.append((F.lit(c), risky, safe, risky - safe, (risky - safe) / (safe + 1e-6) * 100))
    return unpivot_rows(seen, ("feature", "risky_mean", "safe_mean", "difference", "pct_difference"), rows)


def gold_vs_non_gold(fact: DataFrame) -> DataFrame:
    holds_gold = F.col("has_gold_loan")
    known = [(label, c) for label, c in K.GOLD_METRICS if c in fact.columns]
    seen = fact.agg(*[mean_where(F.col(c), cond).alias(f"{c}_{side}") for _, c in known
                      for side, cond in (("gold", holds_gold), ("other", ~holds_gold))])
    rows = [(F.lit(label), F.col(f"{c}_gold"), F.col(f"{c}_other"),
             F.col(f"{c}_gold") - F.col(f"{c}_other")) for label, c in known]
    return unpivot_rows(seen, ("metric", "gold_borrowers", "non_gold", "difference"), rows)


def ttest_gold(fact: DataFrame) -> DataFrame:
    """Two-sample t-test with pooled variance on the default rate of gold-loan holders."""
    holds_gold = F.col("has_gold_loan")
    target = F.col(K.TARGET).cast("double")

    def of(side):
        value = F.when(side, target)
        return F.count(value), F.avg(value), F.var_samp(value)

    (n1, m1, v1), (n2, m2, v2) = of(holds_gold), of(~holds_gold)
    seen = fact.agg(n1.alias("n_gold"), m1.alias("mean_gold"), v1.alias("v1"),
                    n2.alias("n_other"), m2.alias("mean_other"), v2.alias("v2"))
    a, b = F.col("n_gold").cast("double"), F.col("n_other").cast("double")
    pooled = ((a - 1) * F.col("v1") + (b - 1) * F.col("v2")) / F.nullif(a + b - 2, F.lit(0.0))
    error = F.sqrt(pooled * (F.lit(1.0) / F.nullif(a, F.lit(0.0)) + F.lit(1.0) / F.nullif(b, F.lit(0.0))))
    return seen.select("n_gold", "n_other", "mean_gold", "mean_other",
                       ((F.col("mean_gold") - F.col("mean_other")) / F.nullif(error, F.lit(0.0))).alias("t_statistic"),
                       (F.col("n_gold") + F.col("n_other") - 2).alias("degrees_of_freedom"))


def t_critical(freedom: Column) -> Column:
    """Two-sided 5 % limit of Student's t by its series in 1/n; exact to 1e-7 from 98 up."""
    z = NORMAL_QUANTILE
    d = freedom.cast("double")
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96,
             (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    return (F.lit(z) + F.lit(terms[0]) / d + F.lit(terms[1]) / (d * d)
            + F.lit(terms[2]) / (d * d * d))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r over complete pairs; NULL where one side does not vary.

    The built-in aggregate raises a division error there instead.
    """
    x = F.when(b.isNotNull(), a.cast("double"))
    y = F.when(a.isNotNull(), b.cast("double"))
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def signal_table(fact: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Correlation of every numeric feature with the target, all in one pass."""
    names = list(features or numeric_columns(fact, K.SIGNAL_EXCLUDED))
    target = F.col(K.TARGET)
    seen = fact.agg(*[x for c in names for x in (
        correlation(F.col(c), target).alias(f"{c}_r"),
        F.count(F.when(target.isNotNull(), F.col(c))).alias(f"{c}_n"))])
    long = unpivot_rows(seen, ("feature", "r", "n"),
                        [(F.lit(c), F.col(f"{c}_r"), F.col(f"{c}_n")) for c in names])
    r, freedom = F.col("r"), (F.col("n") - 2).cast("double")
    t = r * F.sqrt(freedom / F.nullif(F.lit(1.0) - r * r, F.lit(0.0)))
    higher, lower = K.SIGNAL_DIRECTIONS
    usable = F.col("n") >= MIN_SIGNAL_ROWS
    return long.where(usable & r.isNotNull() & ~F.isnan(r)).select(
        "feature", F.abs(r).alias("correlation"), F.when(r > 0, higher).otherwise(lower).alias("direction"),
        t.alias("t_statistic"), F.col("n").alias("n_rows"))


def early_warning_signals(fact: DataFrame, top: int = 20) -> DataFrame:
    """Significant features by strength of association, ranked.

    A perfect correlation has no finite t and counts as significant.
    """
    significant = F.coalesce(F.abs(F.col("t_statistic")) > t_critical(F.col("n_rows") - 2), F.lit(True))
    order = [F.desc("correlation"), F.asc("feature")]
    strongest = signal_table(fact).where(significant).orderBy(*order).limit(top)
    return strongest.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*order)))


def group_p_values(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """p-value of each feature against a two-class label, for all features in one pass.

    With two classes the one-way F equals the squared t, so this serves the correlation
    and the two-sample test alike. A feature with gaps is tested on its own rows; one that
    does not vary has neither F nor p-value and is not significant.
    """
    mark = F.col(label).cast("double")
    seen = df.agg(*[x for c in features for x in (
        correlation(F.col(c), mark).alias(f"{c}_r"), F.count(F.when(mark.isNotNull(), F.col(c))).alias(f"{c}_n"))])
    long = unpivot_rows(seen, ("feature", "r", "n"),
                        [(F.lit(c), F.col(f"{c}_r"), F.col(f"{c}_n")) for c in features])
    known = F.when(F.col("r").isNotNull() & ~F.isnan("r") & (F.col("n") > 2), F.least(F.greatest(F.col("r"), F.lit(-1.0)), F.lit(1.0)))
    freedom = (F.col("n") - 2).cast("double")
    told = with_correlation_p_value(long.withColumn("r", known), "p_value", F.col("r"), freedom)
    square = F.col("r") * F.col("r")
    f_value = F.when(square < 1, square / (F.lit(1.0) - square) * freedom).when(square == 1, F.lit(float("inf")))
    return told.select("feature", "p_value", f_value.alias("f_value"),
                       F.coalesce(F.col("p_value") < SIGNIFICANCE, F.lit(False)).alias("significant"))


def signal_p_values(fact: DataFrame) -> DataFrame:
    return group_p_values(fact, numeric_columns(fact, K.SIGNAL_EXCLUDED), K.TARGET)


def signals_with_p_values(fact: DataFrame, top: int = 20) -> DataFrame:
    """The early-warning list with the p-value of each signal."""
    strongest = early_warning_signals(fact, top)
    tested = signal_p_values(fact).select("feature", "p_value", "significant")
    return strongest.join(tested, "feature", "left").orderBy("rank")


def ttest_gold_p_value(fact: DataFrame) -> DataFrame:
    flagged = fact.select(F.col("has_gold_loan").cast("int").alias("gold"), K.TARGET)
    return group_p_values(flagged, [K.TARGET], "gold")
