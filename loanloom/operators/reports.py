"""The report library: ten questions about the book.

Each report reads one of the operational tables once. Results are unrounded;
``REPORTS`` holds the description and the display digits of each report.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions import bands
from loanloom.functions.columns import (count_where, mean_where, percent, ratio_or_null,
                                        unpivot_rows, weighted_sum)
from loanloom.functions.rounding import present


def _defaults() -> Column:
    return F.sum(F.col(K.TARGET).cast("long"))


def _default_rate() -> Column:
    return F.avg(K.TARGET) * 100


def _portfolio_share(count: str = "borrower_count") -> Column:
    """Share of the grand total; used on banded results of a handful of rows only."""
    return percent(F.col(count), F.sum(count).over(Window.partitionBy()))


def portfolio_health(borrowers: DataFrame) -> DataFrame:
    delinquent = count_where(F.col("num_times_delinquent") > 0)
    return borrowers.agg(
        F.count("*").alias("total_borrowers"), _defaults().alias("total_defaults"),
        _default_rate().alias("default_rate_pct"),
        F.avg("NETMONTHLYINCOME").alias("avg_monthly_income"), F.avg("AGE").alias("avg_age"),
        F.avg("Total_TL").alias("avg_total_loans"),
        (F.avg("active_loan_ratio") * 100).alias("avg_active_loan_ratio_pct"),
        F.avg("num_times_delinquent").alias("avg_delinquencies"),
        delinquent.alias("ever_delinquent_count"),
        percent(delinquent, F.count("*")).alias("ever_delinquent_pct"),
        F.avg("enq_L6m").alias("avg_enquiries_6m"), F.avg("enq_L12m").alias("avg_enquiries_12m"))


def default_by_segment(risk_segments: DataFrame) -> DataFrame:
    grouped = risk_segments.groupBy("risk_segment").agg(
        F.count("*").alias("borrower_count"), _defaults().alias("defaults"),
        _default_rate().alias("default_rate_pct"), F.avg("NETMONTHLYINCOME").alias("avg_income"),
        F.avg("AGE").alias("avg_age"))
    return (grouped.withColumn("pct_of_portfolio", _portfolio_share())
            .orderBy(F.desc("default_rate_pct")))


def enquiry_lift(borrowers: DataFrame) -> DataFrame:
    """Default rate by enquiry count and its ratio to the rate of the whole book."""
    raw = F.col("enq_L6m")
    grouped = borrowers.groupBy(raw.alias("raw_enq_L6m")).agg(
        F.count("*").alias("borrower_count"), _defaults().alias("defaults"),
        F.count(K.TARGET).alias("labelled"))
    book = grouped.agg(ratio_or_null(F.sum("defaults"), F.sum("labelled"))).scalar()
    rate = ratio_or_null(F.col("defaults"), F.col("labelled"))
    return grouped.select(
        bands.enquiry_label(F.col("raw_enq_L6m")).alias("enquiry_band"), "raw_enq_L6m",
        "borrower_count", "defaults", (rate * 100).alias("default_rate_pct"),
        ratio_or_null(rate, book).alias("lift_over_baseline")).orderBy("raw_enq_L6m")


def funnel_counts(borrowers: DataFrame) -> DataFrame:
    return borrowers.agg(
        F.count("*").alias("book"), count_where(F.col("num_times_delinquent") > 0).alias("ever30"),
        count_where(F.col("num_times_60p_dpd") > 0).alias("ever60"), _defaults().alias("defaulted"))


def delinquency_funnel(borrowers: DataFrame) -> DataFrame:
    """Four stages from one pass: count, share of the book, share of the previous stage."""
    book, ever30, ever60, defaulted = (F.col(c) for c in ("book", "ever30", "ever60", "defaulted"))
    nothing = F.lit(None).cast("double")
    moved = (nothing, nothing, percent(ever60, ever30), percent(defaulted, ever60))
    shares = (F.lit(100.0), *[percent(c, book) for c in (ever30, ever60, defaulted)])
    names = ("stage", "count", "pct_of_portfolio", "transition_rate_from_prev")
    rows = [(F.lit(stage), count, share, step) for stage, count, share, step in
            zip(K.FUNNEL_STAGES, (book, ever30, ever60, defaulted), shares, moved)]
    return unpivot_rows(funnel_counts(borrowers), names, rows)


def history_vs_default(borrowers: DataFrame) -> DataFrame:
    grouped = (borrowers.where(F.col("Age_Oldest_TL").isNotNull())
               .groupBy(bands.history_label(F.col("Age_Oldest_TL")).alias("credit_history_band"))
               .agg(F.count("*").alias("borrower_count"), _defaults().alias("defaults"),
                    _default_rate().alias("default_rate_pct"),
                    F.avg("enq_L6m").alias("avg_recent_enquiries"),
                    F.avg("num_times_delinquent").alias("avg_delinquencies"),
                    F.avg("Age_Oldest_TL").alias("_place")))
    safest = F.min("default_rate_pct").over(Window.partitionBy())
    return (grouped.withColumns({"pct_of_portfolio": _portfolio_share(),
                                 "relative_risk_vs_safest": ratio_or_null(F.col("default_rate_pct"), safest)})
            .orderBy("_place").drop("_place"))


def high_risk_rules(borrowers: DataFrame) -> DataFrame:
    """Four review rules from one pass: who they flag and the default rate among those."""
    many, thin = F.col("enq_L6m") >= 4, F.col("Age_Oldest_TL") < 24
    rules = (many, thin, F.col("num_times_60p_dpd") >= 1, many & thin)
    measured = borrowers.agg(
        F.count("*").alias("book"),
        *[count_where(rule).alias(f"n{i}") for i, rule in enumerate(rules)],
        *[(mean_where(F.col(K.TARGET), rule) * 100).alias(f"rate{i}") for i, rule in enumerate(rules)])
    names = ("policy_rule", "flagged_count", "pct_of_portfolio", "default_rate_in_segment")
    rows = [(F.lit(label), F.col(f"n{i}"), percent(F.col(f"n{i}"), F.col("book")), F.col(f"rate{i}"))
            for i, label in enumerate(K.HIGH_RISK_RULES)]
    return (unpivot_rows(measured, names, rows)
            .orderBy(F.desc_nulls_last("default_rate_in_segment"), "policy_rule"))


def income_vs_default(borrowers: DataFrame) -> DataFrame:
    """Default rate by income, overall and among frequent and rare credit seekers."""
    enquiries, target = F.col("enq_L6m"), F.col(K.TARGET)
    return (borrowers.where(F.col("NETMONTHLYINCOME").isNotNull())
            .groupBy(bands.income_label(F.col("NETMONTHLYINCOME")).alias("income_band"))
            .agg(F.count("*").alias("borrower_count"), _default_rate().alias("default_rate_pct"),
                 F.avg("enq_L6m").alias("avg_enquiries_6m"),
                 F.avg("num_times_delinquent").alias("avg_delinquencies"),
                 F.avg("Age_Oldest_TL").alias("avg_credit_history_months"),
                 (mean_where(target, enquiries >= 4) * 100).alias("default_rate_high_enquiry_pct"),
                 (mean_where(target, enquiries <= 1) * 100).alias("default_rate_low_enquiry_pct"))
            .orderBy("income_band"))


def gold_loan_buckets(borrowers: DataFrame) -> DataFrame:
    grouped = (borrowers.where(F.col("Gold_TL").isNotNull())
               .groupBy(bands.gold_loan_label(F.col("Gold_TL")).alias("gold_loan_bucket"))
               .agg(F.count("*").alias("borrower_count"), _defaults().alias("defaults"),
                    _default_rate().alias("default_rate_pct"),
                    F.avg("NETMONTHLYINCOME").alias("avg_monthly_income"),
                    F.avg("enq_L6m").alias("avg_recent_enquiries"),
                    F.avg("num_times_delinquent").alias("avg_delinquencies"),
                    F.avg("Total_TL").alias("avg_total_loans"),
                    (F.avg("active_loan_ratio") * 100).alias("avg_active_ratio_pct"),
                    F.avg("Gold_TL").alias("_place")))
    return grouped.withColumn("pct_of_portfolio", _portfolio_share()).orderBy("_place").drop("_place")


def early_intervention(borrowers: DataFrame, limit: int = 500) -> DataFrame:
    """Borrowers not in default who show warning signs, most urgent first."""
    enquiries, delays = F.col("enq_L6m"), F.col("num_times_delinquent")
    missed, history = F.col("missed_payment_ratio"), F.col("Age_Oldest_TL")
    thin = history < 24
    warned = ((enquiries >= 3) | (delays >= 2) | (missed >= 0.2) | ((enquiries >= 2) & thin))
    extreme, high, medium, low = K.INTERVENTION_PRIORITIES
    priority = (F.when((enquiries >= 4) & thin, extreme)
                .when((enquiries >= 4) | (F.col("num_times_60p_dpd") >= 1), high)
                .when((enquiries >= 2) | (delays >= 2), medium).otherwise(low))
    return (borrowers.where((F.col(K.TARGET) == 0) & warned)
            .select("borrower_id", enquiries.alias("recent_enquiries_6m"),
                    delays.alias("total_delinquencies"),
                    F.col("num_times_60p_dpd").alias("serious_delinquencies"),
                    "missed_payment_ratio", "active_loan_ratio",
                    history.alias("credit_history_months"),
                    F.col("NETMONTHLYINCOME").alias("monthly_income"),
                    weighted_sum(K.INTERVENTION_WEIGHTS).alias("intervention_score"),
                    priority.alias("intervention_priority"))
            .orderBy(F.desc_nulls_last("intervention_score"), "borrower_id").limit(limit))


def policy_impact(borrowers: DataFrame) -> DataFrame:
    """Defaults caught by each policy and the default rate left after all of them."""
    bad = F.col(K.TARGET) == 1
    many, thin = F.col("enq_L6m") >= 4, F.col("Age_Oldest_TL") < 24
    saved = (F.col("num_times_delinquent") >= 1) & (F.col("num_times_60p_dpd") == 0)
    measured = borrowers.agg(
        F.count("*").alias("total_borrowers"), _defaults().alias("baseline_defaults"),
        _default_rate().alias("baseline_npa_pct"),
        count_where(many & bad).alias("defaults_flagged_policy1"),
        count_where(thin & bad).alias("defaults_flagged_policy2"),
        count_where(saved & bad).alias("_saved"), count_where((many | thin) & bad).alias("_caught"))
    defaults = F.col("baseline_defaults")
    left = (defaults - F.col("_caught") * F.lit(K.POLICY_ACTION_RATE)
            - F.col("_saved") * F.lit(K.POLICY_SAVE_RATE))
    return measured.select(
        "total_borrowers", "baseline_defaults", "baseline_npa_pct", "defaults_flagged_policy1",
        percent(F.col("defaults_flagged_policy1"), defaults).alias("pct_defaults_caught_policy1"),
        "defaults_flagged_policy2",
        percent(F.col("defaults_flagged_policy2"), defaults).alias("pct_defaults_caught_policy2"),
        (F.col("_saved") * F.lit(K.POLICY_SAVE_RATE)).alias("defaults_saved_policy3"),
        percent(left, F.col("total_borrowers")).alias("estimated_npa_after_policies"))


@dataclass(frozen=True)
class Report:
    """A named report: the table it reads, the question it answers, its display digits."""

    description: str
    table: str
    build: Callable[[DataFrame], DataFrame]
    digits: dict[str, int] = field(default_factory=dict)

    def run(self, tables: dict[str, DataFrame]) -> DataFrame:
        return present(self.build(tables[self.table]), self.digits)


# ---- fixed values: names, questions and display digits of the ten reports -----------------
REPORTS = {
    "01_portfolio_health": Report(
        "Portfolio KPIs — how risky is our overall loan book?", "borrowers", portfolio_health,
        {"default_rate_pct": 2, "avg_monthly_income": 0, "avg_age": 1, "avg_total_loans": 1,
         "avg_active_loan_ratio_pct": 2, "avg_delinquencies": 2, "ever_delinquent_pct": 2,
         "avg_enquiries_6m": 2, "avg_enquiries_12m": 2}),
    "02_default_by_segment": Report(
        "Default rate by risk segment and demographics", "risk_segments", default_by_segment,
        {"pct_of_portfolio": 2, "default_rate_pct": 2, "avg_income": 0, "avg_age": 1}),
    "03_enquiry_default_correlation": Report(
        "Does credit-seeking behaviour predict default?", "borrowers", enquiry_lift,
        {"default_rate_pct": 2, "lift_over_baseline": 2}),
    "04_delinquency_funnel": Report(
        "Repayment journey: active → 30DPD → 60DPD → default", "borrowers", delinquency_funnel,
        {"pct_of_portfolio": 2, "transition_rate_from_prev": 2}),
    "05_credit_history_vs_default": Report(
        "Does credit history length protect against default?", "borrowers", history_vs_default,
        {"pct_of_portfolio": 2, "default_rate_pct": 2, "avg_recent_enquiries": 2,
         "avg_delinquencies": 2, "relative_risk_vs_safest": 2}),
    "06_high_risk_identification": Report(
        "Which borrower profiles trigger automatic review?", "borrowers", high_risk_rules,
        {"pct_of_portfolio": 2, "default_rate_in_segment": 2}),
    "07_income_default_analysis": Report(
        "Is income a reliable risk predictor vs behaviour?", "borrowers", income_vs_default,
        {"default_rate_pct": 2, "avg_enquiries_6m": 2, "avg_delinquencies": 2,
         "avg_credit_history_months": 0, "default_rate_high_enquiry_pct": 2,
         "default_rate_low_enquiry_pct": 2}),
    "08_gold_loan_analysis": Report(
        "Does a gold loan go with a higher default rate?", "borrowers", gold_loan_buckets,
        {"pct_of_portfolio": 2, "default_rate_pct": 2, "avg_monthly_income": 0,
         "avg_recent_enquiries": 2, "avg_delinquencies": 2, "avg_total_loans": 1,
         "avg_active_ratio_pct": 2}),
    "09_early_intervention_candidates": Report(
        "Which borrowers need collections outreach NOW?", "borrowers", early_intervention,
        {"intervention_score": 3}),
    "10_policy_impact_simulation": Report(
        "Estimated NPA reduction from 3 credit policies", "borrowers", policy_impact,
        {"baseline_npa_pct": 2, "pct_defaults_caught_policy1": 2, "pct_defaults_caught_policy2": 2,
         "defaults_saved_policy3": 0, "estimated_npa_after_policies": 2}),
}
