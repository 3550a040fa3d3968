"""The scored export: flags, expected loss, bands and ranks, one row per borrower."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions import bands
from loanloom.functions.columns import (at_least_zero, count_where, first_present, flag, to_number)
from loanloom.functions.ordered import dense_ranks_desc

# ---- fixed values: column order of the export, inputs in order of preference ---------------
ID_COLUMNS = ("customer_id", "Customer_ID", "PROSPECTID", "borrower_id")
BUSINESS_COLUMNS = (
    "predicted_pd", "pd_band", "approved_flag", "rejected_flag", "ead_proxy", "lgd_assumption",
    "expected_loss", "high_risk_flag", "watchlist_flag", "priority_score", "default_actual_label",
    "age_band", "income_band", "enquiry_band", "delinquency_band", "credit_history_band",
    "risk_rank", "loss_rank")
ENQUIRY_SOURCES = ("tot_enq", "enq_L12m", "enq_L6m")
DELINQUENCY_SOURCES = ("num_times_delinquent", "num_times_60p_dpd", "delinquency_score")
NUMERIC_INPUTS = (
    "AGE", "NETMONTHLYINCOME", "enq_L6m", "enq_L12m", "tot_enq", "num_times_delinquent",
    "num_times_60p_dpd", "delinquency_score", "missed_payment_ratio", "Total_TL",
    "active_loan_ratio", "loan_type_diversity", "Age_Oldest_TL", "Gold_TL", "Home_TL",
    "default_risk")


def decision_flags(df: DataFrame) -> DataFrame:
    pd = F.col("predicted_pd")
    return df.withColumns({
        "approved_flag": flag(pd < K.DECISION_THRESHOLD),
        "rejected_flag": flag(pd >= K.DECISION_THRESHOLD),
        "high_risk_flag": flag(pd >= K.DECISION_THRESHOLD),
        "watchlist_flag": flag(pd >= K.WATCHLIST_THRESHOLD)})


def loss_columns(df: DataFrame) -> DataFrame:
    pd, lgd = F.col("predicted_pd"), F.lit(K.LGD)
    exposure = at_least_zero(F.col("NETMONTHLYINCOME")) * K.EAD_MONTHS
    loss = pd * lgd * exposure
    return df.withColumns({"ead_proxy": exposure, "lgd_assumption": lgd, "expected_loss": loss,
                           "priority_score": pd * loss})


def band_columns(df: DataFrame) -> DataFrame:
    """Six bands; anything outside a band's range reads "Unknown"."""
    def source_value(candidates):
        name = first_present(df, candidates)
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name else F.lit(0.0)

    def labelled(column, band):
        return bands.cut(column, *band, fill="Unknown")

    enquiries, delays = source_value(ENQUIRY_SOURCES), source_value(DELINQUENCY_SOURCES)
    columns = {
        "pd_band": labelled(F.col("predicted_pd"), K.EXPORT_PD_BAND),
        "age_band": labelled(F.col("AGE"), K.EXPORT_AGE_BAND),
        "income_band": labelled(F.col("NETMONTHLYINCOME"), K.EXPORT_INCOME_BAND),
        "enquiry_value": enquiries, "enquiry_band": labelled(enquiries, K.EXPORT_ENQUIRY_BAND),
        "delinquency_value": delays,
        "delinquency_band": labelled(delays, K.EXPORT_DELINQUENCY_BAND),
    }
    if "Age_Oldest_TL" in df.columns:
        columns["credit_history_band"] = labelled(F.col("Age_Oldest_TL"), K.EXPORT_HISTORY_BAND)
    return df.withColumns(columns)


def ranks(df: DataFrame, key: str = K.KEY) -> DataFrame:
    """Dense rank of every borrower by probability and by expected loss."""
    return dense_ranks_desc(df, {"predicted_pd": "risk_rank", "expected_loss": "loss_rank"}, key)


def business_columns(scored: DataFrame, key: str = K.KEY) -> DataFrame:
    numbers = to_number(scored, NUMERIC_INPUTS)
    zero_filled = {c: (F.coalesce(F.col(c), F.lit(0)) if c in numbers.columns else F.lit(0.0))
                   for c in ("NETMONTHLYINCOME", "AGE")}
    filled = numbers.withColumns(zero_filled)
    actual = flag(F.col(K.TARGET) == 1) if K.TARGET in filled.columns else F.lit(None).cast("int")
    return (filled.withColumn("default_actual_label", actual).transform(decision_flags)
            .transform(loss_columns).transform(band_columns).transform(ranks, key))


def reorder_columns(df: DataFrame, features: Sequence[str] = K.FEATURES) -> DataFrame:
    """Identifiers, business columns, model features, everything else."""
    wanted = dict.fromkeys([*ID_COLUMNS, *BUSINESS_COLUMNS, *features])
    front = [c for c in wanted if c in df.columns]
    return df.select(*front, *[c for c in df.columns if c not in wanted])


def scored_export(scored: DataFrame) -> DataFrame:
    return business_columns(scored).transform(reorder_columns)


def named_for_sink(df: DataFrame) -> DataFrame:
    """Outside names: the probability band is called ``risk_band`` in files.

    A table without one is a silver table, whose ``risk_band`` is the grade band.
    """
    source = "pd_band" if "pd_band" in df.columns else "grade_band"
    return df.withColumnRenamed(source, "risk_band")


def export_summary(export: DataFrame) -> DataFrame:
    return export.agg(
        F.count("*").alias("total_rows"), F.avg("approved_flag").alias("approval_rate"),
        F.avg("predicted_pd").alias("avg_pd"), F.avg("high_risk_flag").alias("high_risk_share"),
        count_where(F.col("watchlist_flag") == 1).alias("watchlist_count"),
        F.round(F.sum("expected_loss"), 2).alias("total_expected_loss"))
