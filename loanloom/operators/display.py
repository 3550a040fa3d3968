"""Rounding and column titles of the published tables."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame

from loanloom.functions.rounding import present


class Look(NamedTuple):
    digits: Mapping[str, int]
    titles: Mapping[str, str] = {}


# ---- fixed values: digits and titles by table ----------------------------------------------
LOOKS = {
    "portfolio_summary": Look({
        "default_rate_pct": 2, "avg_predicted_pd_pct": 2, "high_risk_pct": 2, "total_ead_cr": 2,
        "expected_loss_cr": 2, "expected_loss_rate_pct": 2}),
    "pd_band_distribution": Look(
        {"pct_of_portfolio": 1, "avg_pd_pct": 1},
        {"risk_band": "Risk Band", "count": "Count", "pct_of_portfolio": "% Portfolio", "avg_pd_pct": "Avg PD"}),
    "segment_default_rates": Look(
        {"default_rate_pct": 1, "risk_contribution_pct": 1, "pct_of_portfolio": 1},
        {"segment": "Segment", "count": "Count", "defaults": "Defaults", "default_rate_pct": "Default Rate %",
         "risk_contribution_pct": "Risk Contribution %", "pct_of_portfolio": "% of Portfolio"}),
    "expected_loss_by_segment": Look(
        {"avg_pd_pct": 1, "ead_cr": 2, "expected_loss_cr": 2, "el_rate_pct": 2},
        {"segment": "Segment", "count": "Count", "avg_pd_pct": "Avg PD %", "ead_cr": "EAD (₹ Cr)",
         "expected_loss_cr": "Expected Loss (₹ Cr)", "el_rate_pct": "EL Rate %"}),
    "riskiest_segments": Look(
        {"default_rate_pct": 1, "risk_contribution_pct": 1},
        {"dimension": "Dimension", "segment": "Segment", "count": "Count", "default_rate_pct": "Default Rate %",
         "risk_contribution_pct": "Risk Contribution %"}),
    "policy_simulation": Look({
        "approval_rate_pct": 1, "rejection_rate_pct": 1, "default_rate_in_approved_pct": 1,
        "expected_loss_cr": 2, "baseline_el_cr": 2, "el_reduction_cr": 2, "el_reduction_pct": 1}),
    "policy_comparison": Look(
        {"approval_rate_pct": 1, "default_rate_in_approved_pct": 1, "expected_loss_cr": 2, "el_reduction_cr": 2},
        {"policy": "Policy", "approval_rate_pct": "Approval Rate %",
         "default_rate_in_approved_pct": "Default Rate in Approved %", "defaults_prevented": "Defaults Prevented",
         "safe_rejected": "Safe Rejected", "expected_loss_cr": "Expected Loss (₹ Cr)",
         "el_reduction_cr": "EL Reduction (₹ Cr)"}),
    "threshold_table": Look(
        {"approval_rate_pct": 1, "defaults_caught_pct": 1, "false_alarm_rate_pct": 1, "precision_pct": 1, "f1_score": 3},
        {"threshold": "Threshold", "approval_rate_pct": "Approval Rate %", "defaults_caught_pct": "Defaults Caught %",
         "false_alarm_rate_pct": "False Alarm Rate %", "precision_pct": "Precision %", "f1_score": "F1 Score",
         "defaults_missed": "Defaults Missed", "safe_borrowers_rejected": "Safe Borrowers Rejected"}),
    "score_band_table": Look({"default_rate_pct": 2, "avg_income": 0, "avg_loans": 1, "rate_change": 2}),
    "gini_by_tier": Look({"gini_score": 4, "avg_cibil": 1, "default_rate_pct": 2}),
    "early_warning_signals": Look({"correlation": 4, "p_value": 6}),
    "risky_vs_safe": Look({"risky_mean": 2, "safe_mean": 2, "difference": 2, "pct_difference": 1}),
    "gold_vs_non_gold": Look({"gold_borrowers": 3, "non_gold": 3, "difference": 3}),
    "borrower_clusters": Look({
        "avg_cibil": 2, "avg_delinquency": 2, "avg_active_ratio": 2, "avg_credit_history": 2, "avg_income": 2,
        "avg_total_loans": 2, "default_rate_pct": 1}),
    "batch_explain": Look(
        {"predicted_pd_pct": 1},
        {"borrower_id": "Borrower ID", "predicted_pd_pct": "Predicted PD %", "risk_level": "Risk Level",
         "primary_reason": "Primary Reason", "recommendation": "Recommendation"}),
}


def displayed(name: str, df: DataFrame) -> DataFrame:
    """A table as published: rounded half to even, under its titles."""
    look = LOOKS[name]
    return present(df, look.digits, half_even=True).withColumnsRenamed(dict(look.titles))
