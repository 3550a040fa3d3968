"""Portfolio metrics: summaries, segments, expected loss, dashboard feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions import bands
from loanloom.functions.columns import (count_where, fixed_rows, percent, ratio_or_null,
                                        unpivot_rows, weighted_sum)
from loanloom.functions.ordered import fill_median
from loanloom.functions.text import present_text
from loanloom.operators.reports import funnel_counts

PD = "predicted_pd"


def exposure() -> Column:
    return F.col("NETMONTHLYINCOME") * K.EAD_MONTHS


def expected_loss() -> Column:
    return F.col(PD) * F.lit(K.LGD) * exposure()


def with_income(df: DataFrame) -> DataFrame:
    """Missing incomes take the median income before any exposure is computed."""
    return fill_median(df, ["NETMONTHLYINCOME"])


def portfolio_summary(scored: DataFrame) -> DataFrame:
    defaults = F.sum(F.col(K.TARGET).cast("long"))
    pd = F.col(PD)
    ead, loss = F.sum(exposure()), F.sum(expected_loss())
    return with_income(scored).agg(
        F.count("*").alias("total_borrowers"), defaults.alias("total_defaults"),
        percent(defaults, F.count("*")).alias("default_rate_pct"),
        (F.count("*") - defaults).alias("safe_borrowers"),
        (F.avg(pd) * 100).alias("avg_predicted_pd_pct"),
        count_where(pd >= 0.50).alias("high_risk_count"),
        percent(count_where(pd >= 0.50), F.count("*")).alias("high_risk_pct"),
        count_where((pd >= 0.25) & (pd < 0.50)).alias("medium_risk_count"),
        count_where(pd < 0.25).alias("low_risk_count"),
        (ead / K.CRORE).alias("total_ead_cr"), (loss / K.CRORE).alias("expected_loss_cr"),
        percent(loss, ead).alias("expected_loss_rate_pct"))


def headline_kpis(scored: DataFrame) -> DataFrame:
    pd = F.col(PD)
    return with_income(scored).agg(
        F.count("*").alias("borrowers"), F.avg(K.TARGET).alias("default_rate"),
        F.avg((pd < K.DECISION_THRESHOLD).cast("int")).alias("approval_rate"),
        F.avg(pd).alias("avg_pd"), count_where(pd >= K.DECISION_THRESHOLD).alias("high_risk_count"),
        (F.sum(expected_loss()) / K.CRORE).alias("expected_loss_cr"),
        (F.sum(exposure()) / K.CRORE).alias("ead_cr"))


def pd_band_distribution(scored: DataFrame) -> DataFrame:
    """The three probability bands, empty ones included; a probability of 1 is in none."""
    found = scored.groupBy(bands.pd_band(F.col(PD)).alias("risk_band")).agg(
        F.count("*").alias("n"), F.avg(PD).alias("mean_pd"))
    names = fixed_rows(scored.sparkSession, "risk_band string, band_order int",
                       [(name, i) for i, (name, _, _) in enumerate(K.PD_BANDS)])
    book = found.agg(F.sum("n")).scalar()
    n = F.coalesce(F.col("n"), F.lit(0))
    return (names.join(found, "risk_band", "left")
            .select("risk_band", "band_order", n.alias("count"),
                    F.coalesce(percent(n, book), F.lit(0.0)).alias("pct_of_portfolio"),
                    F.coalesce(F.col("mean_pd") * 100, F.lit(0.0)).alias("avg_pd_pct"))
            .orderBy("band_order"))


def _segmented(df: DataFrame, column: str, edges: Sequence[float] | None,
               labels: Sequence[str] | None) -> Column:
    if edges is None:
        return F.col(column).cast("string")
    return bands.cut(F.col(column), edges, labels)


def segment_default_rates(df: DataFrame, column: str, edges: Sequence[float] | None = None,
                          labels: Sequence[str] | None = None) -> DataFrame:
    """Default rate, share of defaults and share of the book per segment.

    Rows outside every segment are not listed but stay in both totals.
    """
    grouped = df.groupBy(_segmented(df, column, edges, labels).alias("segment")).agg(
        F.count("*").alias("rows"), F.count(K.TARGET).alias("count"),
        F.coalesce(F.sum(F.col(K.TARGET).cast("long")), F.lit(0)).alias("defaults"))
    all_rows = grouped.agg(F.sum("rows")).scalar()
    all_defaults = grouped.agg(F.sum("defaults")).scalar()
    return (grouped.where(F.col("segment").isNotNull())
            .select("segment", "count", "defaults",
                    percent(F.col("defaults"), F.col("count")).alias("default_rate_pct"),
                    percent(F.col("defaults"), all_defaults).alias("risk_contribution_pct"),
                    percent(F.col("count"), all_rows).alias("pct_of_portfolio"))
            .orderBy(F.desc_nulls_last("default_rate_pct"), "segment"))


def expected_loss_by_segment(scored: DataFrame, column: str, edges: Sequence[float] | None = None,
                             labels: Sequence[str] | None = None) -> DataFrame:
    filled = with_income(scored)
    return (filled.groupBy(_segmented(filled, column, edges, labels).alias("segment"))
            .agg(F.count(PD).alias("count"), (F.avg(PD) * 100).alias("avg_pd_pct"),
                 (F.sum(exposure()) / K.CRORE).alias("ead_cr"),
                 (F.sum(expected_loss()) / K.CRORE).alias("expected_loss_cr"),
                 percent(F.sum(expected_loss()), F.sum(exposure())).alias("el_rate_pct"))
            .where(F.col("segment").isNotNull())
            .orderBy(F.desc_nulls_last("el_rate_pct"), "segment"))


def riskiest_segments(df: DataFrame, n: int = 5) -> DataFrame:
    """Worst segments across the age and income dimensions, ranked."""
    dimensions = (("Age Group", "AGE", K.LEADERBOARD_AGE_BAND),
                  ("Income Band", "NETMONTHLYINCOME", K.LEADERBOARD_INCOME_BAND))
    known = [(name, column, band) for name, column, band in dimensions if column in df.columns]
    entries = unpivot_rows(df, ("dimension", "segment", K.TARGET), [
        (F.lit(name), bands.cut(F.col(column), *band), F.col(K.TARGET)) for name, column, band in known])
    grouped = entries.groupBy("dimension", "segment").agg(
        F.count(K.TARGET).alias("count"),
        F.coalesce(F.sum(F.col(K.TARGET).cast("long")), F.lit(0)).alias("defaults"))
    everyone = grouped.where(F.col("dimension") == known[0][0]).agg(F.sum("defaults")).scalar()
    board = grouped.where(F.col("segment").isNotNull()).select(
        "dimension", "segment", "count",
        percent(F.col("defaults"), F.col("count")).alias("default_rate_pct"),
        percent(F.col("defaults"), everyone).alias("risk_contribution_pct"))
    order = [F.desc_nulls_last("default_rate_pct"), F.asc("dimension"), F.asc("segment")]
    top = board.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*order)))


def segment_contribution(borrowers: DataFrame, dimension: str) -> DataFrame:
    """Dashboard segments of one dimension, ordered by their smallest value."""
    column, label = {
        "enquiry": ("enq_L6m", lambda c: bands.enquiry_label(c, K.ENQUIRY_SEGMENTS)),
        "age": ("AGE", bands.age_segment),
        "income": ("NETMONTHLYINCOME", lambda c: bands.income_label(c, K.INCOME_SEGMENTS)),
        "history": ("Age_Oldest_TL", lambda c: bands.history_label(c, K.HISTORY_SEGMENTS)),
    }[dimension]
    # income and history leave rows without a value out; the total keeps them
    kept = F.lit(True) if dimension in ("enquiry", "age") else F.col(column).isNotNull()
    grouped = borrowers.groupBy(F.when(kept, label(F.col(column))).alias("segment")).agg(
        F.count("*").alias("count"), (F.avg(K.TARGET) * 100).alias("default_rate_pct"),
        F.coalesce(F.sum(F.col(K.TARGET).cast("long")), F.lit(0)).alias("_defaults"),
        F.min(column).alias("_place"))
    everyone = grouped.agg(F.sum("_defaults")).scalar()
    return (grouped.where(F.col("segment").isNotNull())
            .withColumn("contribution_pct", percent(F.col("_defaults"), everyone))
            .orderBy(F.asc_nulls_first("_place")).drop("_place", "_defaults"))


def income_chart(borrowers: DataFrame) -> DataFrame:
    income = F.col("NETMONTHLYINCOME")
    return (borrowers.where(income.isNotNull())
            .groupBy(bands.income_label(income, K.INCOME_CHART_LABELS).alias("band"))
            .agg((F.avg(K.TARGET) * 100).alias("default_rate_pct"), F.count("*").alias("count"))
            .orderBy("band"))


def funnel_transitions(borrowers: DataFrame) -> DataFrame:
    """Three step rates; an empty earlier stage divides by one."""
    book, ever30, ever60, defaulted = (F.col(c).cast("double")
                                       for c in ("book", "ever30", "ever60", "defaulted"))
    one = F.lit(1.0)
    rates = (ratio_or_null(ever30, book), ever60 / F.greatest(ever30, one),
             defaulted / F.greatest(ever60, one))
    rows = [(F.lit(name), rate) for name, rate in zip(K.FUNNEL_TRANSITIONS, rates)]
    return unpivot_rows(funnel_counts(borrowers), ("transition", "rate"), rows)


def pd_histogram(scored: DataFrame, bins: int = 40, label: str = K.TARGET) -> DataFrame:
    """Share of each class per probability bin; the last bin includes probability 1."""
    bin_number = F.least(F.floor(F.col(PD) * bins), F.lit(bins - 1)).cast("int")
    counted = (scored.where(F.col(PD).isNotNull()).groupBy(label, bin_number.alias("bin"))
               .agg(F.count("*").alias("count")))
    in_class = F.sum("count").over(Window.partitionBy(label))
    return counted.withColumns({"bin_start": F.col("bin") / F.lit(float(bins)),
                                "probability": ratio_or_null(F.col("count"), in_class)})


def watchlist(borrowers: DataFrame, limit: int = 30) -> DataFrame:
    """The most urgent borrowers not in default."""
    enquiries, delays, missed = (F.col(c) for c in ("enq_L6m", "num_times_delinquent", "missed_payment_ratio"))
    extreme, high, medium = K.WATCHLIST_PRIORITIES
    priority = (F.when((enquiries >= 4) & (F.col("Age_Oldest_TL") < 24), extreme)
                .when((enquiries >= 4) | (F.col("num_times_60p_dpd") >= 1), high).otherwise(medium))
    warned = (enquiries >= 3) | (delays >= 2) | (missed >= 0.25)
    return (borrowers.where((F.col(K.TARGET) == 0) & warned)
            .select("borrower_id", enquiries.alias("enquiries_6m"), delays.alias("delinquencies"),
                    F.col("num_times_60p_dpd").alias("delinquencies_60dpd"),
                    missed.alias("missed_payment_ratio"),
                    weighted_sum(K.WATCHLIST_WEIGHTS).alias("score"), priority.alias("priority"))
            .orderBy(F.desc_nulls_last("score"), "borrower_id").limit(limit))


def watchlist_priorities(listed: DataFrame) -> DataFrame:
    return listed.groupBy("priority").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "priority")


def distinct_labels(df: DataFrame, column: str) -> DataFrame:
    return df.select(present_text(F.col(column)).alias("label")).distinct().orderBy("label")
