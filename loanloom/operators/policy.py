"""Underwriting policies as predicates, and what they would have done to the book."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions.columns import count_where, holds, percent, unpivot_rows
from loanloom.operators.portfolio import PD, expected_loss, with_income

FLAT_EXPOSURE = 300_000.0


@dataclass(frozen=True)
class Policy:
    """Limits an application must keep; ``None`` switches a rule off.

    The defaults restrict nothing, yet a missing value fails every rule that is on.
    """

    name: str = "Custom Policy"
    max_enq_6m: int | None = 999
    min_credit_history_months: int | None = 0
    max_delinquencies: int | None = 999
    max_60dpd: int | None = 999
    min_monthly_income: float | None = 0
    max_predicted_pd: float | None = 1.0
    max_active_loan_ratio: float | None = 1.0

    def approves(self, df: DataFrame) -> Column:
        """One predicate over the rules that are on and whose column exists."""
        income = F.coalesce(F.col("NETMONTHLYINCOME"), F.lit(0.0))
        rules = (
            ("enq_L6m", self.max_enq_6m, lambda limit: F.col("enq_L6m") <= limit),
            ("Age_Oldest_TL", self.min_credit_history_months, lambda limit: F.col("Age_Oldest_TL") >= limit),
            ("num_times_delinquent", self.max_delinquencies, lambda limit: F.col("num_times_delinquent") <= limit),
            ("num_times_60p_dpd", self.max_60dpd, lambda limit: F.col("num_times_60p_dpd") <= limit),
            ("NETMONTHLYINCOME", self.min_monthly_income, lambda limit: income >= limit),
            (PD, self.max_predicted_pd, lambda limit: F.col(PD) <= limit),
            ("active_loan_ratio", self.max_active_loan_ratio, lambda limit: F.col("active_loan_ratio") <= limit),
        )
        kept = [holds(rule(F.lit(limit))) for column, limit, rule in rules
                if limit is not None and column in df.columns]
        return reduce(and_, kept, F.lit(True))


# ---- fixed values: the preset policies ------------------------------------------------------
CURRENT = Policy("Current Policy (No Restrictions)")
CONSERVATIVE = Policy("Conservative Policy", max_enq_6m=3, min_credit_history_months=12,
                      max_delinquencies=2, max_60dpd=0, min_monthly_income=10000,
                      max_predicted_pd=0.45)
RECOMMENDED = Policy("Model B Recommended (3 Policies)", max_enq_6m=4, min_credit_history_months=24,
                     max_delinquencies=5, max_predicted_pd=0.50)
GROWTH = Policy("Growth Mode (Relaxed)", max_enq_6m=999, min_credit_history_months=0,
                max_predicted_pd=0.65)
PRESETS = (CURRENT, CONSERVATIVE, RECOMMENDED, GROWTH)

# ---- fixed values: positions at which a slider switches its rule off --------------------------
SLIDER_OFF = {"max_enq_6m": 15, "max_delinquencies": 20, "max_60dpd": 10,
              "max_active_loan_ratio": 1.0, "min_credit_history_months": 0, "min_monthly_income": 0}


def from_sliders(max_predicted_pd: float = 0.50, **limits) -> Policy:
    """Interactive settings: a rule at the end of its slider does not apply at all."""
    chosen = {}
    for rule, off in SLIDER_OFF.items():
        limit = limits.get(rule, off)
        inactive = limit <= off if rule.startswith("min_") else limit >= off
        chosen[rule] = None if inactive else limit
    return Policy("Interactive", max_predicted_pd=max_predicted_pd, **chosen)


def apply_policy(df: DataFrame, policy: Policy) -> DataFrame:
    return df.withColumn("approved", policy.approves(df))


def _actual(df: DataFrame) -> Column:
    return F.col(K.TARGET) if K.TARGET in df.columns else F.lit(0)


def _with_loss(df: DataFrame) -> DataFrame:
    if "NETMONTHLYINCOME" in df.columns:
        # the median stands in for a missing income in the exposure only; rules see the gap
        filled = with_income(df.withColumn("_stated_income", F.col("NETMONTHLYINCOME"))).withColumn("_loss", expected_loss())
        return filled.withColumn("NETMONTHLYINCOME", F.col("_stated_income")).drop("_stated_income")
    return df.withColumn("_loss", F.col(PD) * F.lit(K.LGD) * F.lit(FLAT_EXPOSURE))


def _measures(df: DataFrame, policy: Policy, prefix: str) -> list[Column]:
    ok, bad = policy.approves(df), _actual(df) == 1
    safe = _actual(df) == 0
    return [count_where(ok).alias(f"{prefix}_approved"),
            count_where(ok & bad).alias(f"{prefix}_bad_in"),
            count_where(~ok & bad).alias(f"{prefix}_prevented"),
            count_where(~ok & safe).alias(f"{prefix}_safe_out"),
            F.coalesce(F.sum(F.when(ok, F.col("_loss"))), F.lit(0.0)).alias(f"{prefix}_loss")]


SIMULATION_COLUMNS = (
    "policy_name", "n_total", "n_approved", "approval_rate_pct", "n_rejected", "rejection_rate_pct",
    "defaults_in_approved", "default_rate_in_approved_pct", "defaults_prevented",
    "safe_borrowers_rejected", "defaults_prevented_vs_baseline", "defaults_prevented_delta",
    "approvals_lost_vs_baseline", "expected_loss_cr", "baseline_el_cr", "el_reduction_cr",
    "el_reduction_pct", "raae")


def _outcome(name: str, prefix: str, baseline: str) -> list[Column]:
    n = F.col("n_total")
    approved, bad_in, prevented, safe_out, loss = (
        F.col(f"{prefix}_{m}") for m in ("approved", "bad_in", "prevented", "safe_out", "loss"))
    base_approved, base_prevented, base_loss = (
        F.col(f"{baseline}_{m}") for m in ("approved", "prevented", "loss"))
    some = F.greatest(approved, F.lit(1)).cast("double")
    saved = base_loss - loss
    return [
        F.lit(name), n, approved, percent(approved, n), n - approved, percent(n - approved, n),
        bad_in, bad_in / some * 100, prevented, safe_out,
        # as published: subtracts every rejection of the baseline, not only its prevented defaults
        prevented - (n - base_approved),
        prevented - base_prevented, base_approved - approved,
        loss / K.CRORE, base_loss / K.CRORE, saved / K.CRORE,
        saved / F.greatest(base_loss, F.lit(1.0)) * 100,
        prevented.cast("double") / (safe_out + 1)]


def simulate_policies(scored: DataFrame, policies: Sequence[Policy],
                      baseline: Policy | None = None) -> DataFrame:
    """Full outcome of every policy against one baseline, from a single pass.

    Without a baseline everybody counts as approved before.
    """
    df = _with_loss(scored)
    everyone = Policy("baseline", *[None] * 7)
    measures = _measures(df, baseline or everyone, "base")
    for i, policy in enumerate(policies):
        measures += _measures(df, policy, f"p{i}")
    measured = df.agg(F.count("*").alias("n_total"), *measures)
    rows = [_outcome(p.name, f"p{i}", "base") for i, p in enumerate(policies)]
    return unpivot_rows(measured, SIMULATION_COLUMNS, rows)


def simulate_policy(scored: DataFrame, policy: Policy, baseline: Policy | None = None) -> DataFrame:
    return simulate_policies(scored, [policy], baseline)


def compare_policies(scored: DataFrame, policies: Sequence[Policy] = PRESETS) -> DataFrame:
    """Side-by-side view; the first policy is the baseline."""
    return simulate_policies(scored, policies, policies[0]).select(
        F.col("policy_name").alias("policy"), "approval_rate_pct", "default_rate_in_approved_pct",
        "defaults_prevented", F.col("safe_borrowers_rejected").alias("safe_rejected"),
        "expected_loss_cr", "el_reduction_cr")


def before_and_after(scored: DataFrame, policy: Policy) -> DataFrame:
    """Counts without and with a policy, for a chart."""
    bad = _actual(scored) == 1
    measured = scored.agg(F.count("*").alias("n"), count_where(bad).alias("bad"),
                          *_measures(_with_zero_loss(scored), policy, "p")[:4])
    zero, n = F.lit(0).cast("long"), F.col("n")
    approved, prevented, safe_out = (F.col(f"p_{m}") for m in ("approved", "prevented", "safe_out"))
    rows = [(F.lit("All Borrowers"), n, n), (F.lit("Approved"), n, approved),
            (F.lit("Rejected"), zero, n - approved), (F.lit("Defaults Caught"), F.col("bad"), prevented),
            (F.lit("Safe Rejected"), zero, safe_out)]
    return unpivot_rows(measured, ("category", "baseline", "with_policy"), rows)


def _with_zero_loss(df: DataFrame) -> DataFrame:
    return df.withColumn("_loss", F.lit(0.0))
