"""Star schema and its summary views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.constants import KEY, TARGET
from loanloom.functions import bands

# ---- fixed values: output name = source column -----------------------------------------
DIM_BORROWER = {
    "borrower_id": KEY, "age": "AGE", "gender": "GENDER", "marital_status": "MARITALSTATUS",
    "education": "EDUCATION", "monthly_income_inr": "NETMONTHLYINCOME",
    "income_tier": "income_tier", "months_with_employer": "Time_With_Curr_Empr",
}
DIM_CREDIT = {
    "borrower_id": KEY, "cibil_score": "Credit_Score", "cibil_band": "cibil_band",
    "credit_history_months": "credit_history_months",
    "total_delinquencies": "num_times_delinquent", "times_30dpd": "num_times_30p_dpd",
    "times_60dpd": "num_times_60p_dpd", "delinquency_score": "delinquency_score",
    "total_missed_payments": "Tot_Missed_Pmnt",
    "time_since_recent_payment": "time_since_recent_payment",
    "total_enquiries": "tot_enq", "enquiries_last_6m": "enq_L6m",
    "enquiries_last_12m": "enq_L12m", "last_product_enquired": "last_prod_enq2",
    "first_product_enquired": "first_prod_enq2",
}
DIM_LOAN_PORTFOLIO = {
    "borrower_id": KEY, "total_loans_ever": "Total_TL", "active_loans": "Tot_Active_TL",
    "closed_loans": "Tot_Closed_TL", "active_loan_ratio": "active_loan_ratio",
    "loan_type_diversity": "loan_type_diversity", "gold_loans": "Gold_TL",
    "home_loans": "Home_TL", "personal_loans": "PL_TL", "credit_card_loans": "CC_TL",
    "auto_loans": "Auto_TL", "consumer_loans": "Consumer_TL", "secured_loans": "Secured_TL",
    "unsecured_loans": "Unsecured_TL", "has_gold_loan": "GL_Flag", "has_home_loan": "HL_Flag",
    "has_personal_loan": "PL_Flag", "has_credit_card": "CC_Flag",
    "recently_active": "recently_active",
}
FACT = {
    "borrower_id": KEY, "default_risk": TARGET, "risk_grade": "Approved_Flag",
    "risk_score": "risk_grade", "cibil_score": "Credit_Score",
    "monthly_income_inr": "NETMONTHLYINCOME", "age": "AGE",
    "delinquency_score": "delinquency_score", "missed_payment_ratio": "missed_payment_ratio",
    "active_loan_ratio": "active_loan_ratio", "score_per_income_lakh": "score_per_income_lakh",
    "loan_type_diversity": "loan_type_diversity",
    "credit_history_months": "credit_history_months", "income_tier": "income_tier",
    "cibil_band": "cibil_band", "gender": "GENDER", "education": "EDUCATION",
    "marital_status": "MARITALSTATUS", "total_loans": "Total_TL",
    "num_times_delinquent": "num_times_delinquent", "num_times_60p_dpd": "num_times_60p_dpd",
    "recent_enquiries_6m": "enq_L6m",
}
FACT_HOLDINGS = {"has_gold_loan": "Gold_TL", "has_home_loan": "Home_TL", "has_personal_loan": "PL_TL"}


def _renamed(columns: dict[str, str]) -> list[Column]:
    return [F.col(source).alias(name) for name, source in columns.items()]


def dim_borrower(silver: DataFrame) -> DataFrame:
    return silver.select(*_renamed(DIM_BORROWER),
                         bands.gold_age_band(F.col("AGE")).alias("age_band"))


def dim_credit(silver: DataFrame) -> DataFrame:
    return silver.select(*_renamed(DIM_CREDIT))


def dim_loan_portfolio(silver: DataFrame) -> DataFrame:
    return silver.select(*_renamed(DIM_LOAN_PORTFOLIO))


def fact_credit_risk(silver: DataFrame) -> DataFrame:
    holdings = [(F.col(source) > 0).alias(name) for name, source in FACT_HOLDINGS.items()]
    return silver.select(*_renamed(FACT), *holdings,
                         bands.gold_age_band(F.col("AGE")).alias("age_band"))


def _summary(fact: DataFrame, by: str, *extra: Column) -> DataFrame:
    return fact.groupBy(by).agg(
        F.count("*").alias("total_borrowers"),
        (F.avg(TARGET) * 100).alias("default_rate_pct"),
        F.avg("cibil_score").alias("avg_cibil_score"),
        F.avg("monthly_income_inr").alias("avg_income_inr"), *extra)


def risk_by_score_band(fact: DataFrame) -> DataFrame:
    risky = F.sum(F.col(TARGET).cast("long")).alias("high_risk_count")
    return _summary(fact, "cibil_band", risky).orderBy("avg_cibil_score")


def risk_by_income(fact: DataFrame) -> DataFrame:
    loans = F.avg("total_loans").alias("avg_total_loans")
    return _summary(fact, "income_tier", loans).orderBy("avg_income_inr")


def risk_by_age(fact: DataFrame) -> DataFrame:
    return _summary(fact, "age_band").orderBy("age_band")


def risk_by_gold_loan(fact: DataFrame) -> DataFrame:
    return _summary(fact, "has_gold_loan", F.avg("total_loans").alias("avg_total_loans"))


def risk_by_education(fact: DataFrame) -> DataFrame:
    return _summary(fact, "education").orderBy(F.desc("default_rate_pct"))


# name of each Gold output = how it is built from the silver table
OUTPUTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "dim_borrower": dim_borrower,
    "dim_credit": dim_credit,
    "dim_loan_portfolio": dim_loan_portfolio,
    "fact_credit_risk": fact_credit_risk,
    "v_risk_by_cibil_band": lambda silver: risk_by_score_band(fact_credit_risk(silver)),
    "v_risk_by_income": lambda silver: risk_by_income(fact_credit_risk(silver)),
    "v_risk_by_age": lambda silver: risk_by_age(fact_credit_risk(silver)),
    "v_gold_loan_analysis": lambda silver: risk_by_gold_loan(fact_credit_risk(silver)),
    "v_risk_by_education": lambda silver: risk_by_education(fact_credit_risk(silver)),
}


def star_schema(silver: DataFrame) -> dict[str, DataFrame]:
    """All nine Gold outputs by name."""
    return {name: build(silver) for name, build in OUTPUTS.items()}


def star_join(fact: DataFrame, *dimensions: DataFrame) -> DataFrame:
    """Fact with its dimensions on the borrower key; a column already present is not repeated."""
    joined = fact
    for dimension in dimensions:
        new = [c for c in dimension.columns if c == "borrower_id" or c not in joined.columns]
        joined = joined.join(dimension.select(*new), "borrower_id")
    return joined
