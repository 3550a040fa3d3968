"""Cleaning and feature derivation: raw bank and bureau files -> one borrower table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions import bands
from loanloom.functions.columns import (at_least_zero, flag, guarded_ratio, mapped,
                                        matching_columns, numeric_columns, total)
from loanloom.functions.text import present_text, title_case


def drop_metadata(df: DataFrame) -> DataFrame:
    return df.drop(*K.META_COLUMNS)


def encode_target(df: DataFrame) -> DataFrame:
    """Grade as 1..4 (NULL if unknown) and the 0/1 target; an unknown grade counts as safe."""
    grade = F.col("Approved_Flag")
    return df.withColumns({
        "risk_grade": mapped(grade, K.GRADE_ORDINAL),
        K.TARGET: flag(grade.isin(*K.RISKY_GRADES)),
    })


def clean_sentinels(df: DataFrame) -> DataFrame:
    """Resolve the not-applicable marker in utilisation, elapsed-time and delay-level columns.

    Borrowers without any loan get the largest history (9999), so history bands count
    them as longest. Columns outside the name patterns keep the marker.
    """
    numeric = set(numeric_columns(df))
    marker = F.lit(K.NOT_APPLICABLE)

    def replaced(name: str, value):
        column = F.col(name)
        return F.when(column == marker, F.lit(value)).otherwise(column).cast(df.schema[name].dataType)

    changes = {}
    for name, flag_name in K.UTILISATION_FLAGS.items():
        if name in numeric:
            changes[flag_name] = F.coalesce(F.col(name) != marker, F.lit(True)).cast("int")
            changes[name] = replaced(name, 0)
    for name in matching_columns(df, K.ELAPSED_TIME_PATTERNS):
        if name in numeric:
            changes[name] = replaced(name, K.ELAPSED_TIME_FILL)
    for name in matching_columns(df, K.DELINQUENCY_LEVEL_PATTERNS):
        if name in numeric:
            changes[name] = replaced(name, 0)
    return df.withColumns(changes) if changes else df


def clean_categories(df: DataFrame, null_text: str = "nan") -> DataFrame:
    def tidy(name):
        return present_text(F.col(name), null_text)

    rules = {
        "MARITALSTATUS": title_case(tidy("MARITALSTATUS")),
        "EDUCATION": mapped(F.upper(tidy("EDUCATION")), K.EDUCATION_LEVELS, "OTHERS"),
        "GENDER": F.upper(tidy("GENDER")),
        "last_prod_enq2": tidy("last_prod_enq2"),
        "first_prod_enq2": tidy("first_prod_enq2"),
    }
    return df.withColumns({name: rule for name, rule in rules.items() if name in df.columns})


def category_counts(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of each text column before and after cleaning.

    Values are reduced to one row each before they are counted.
    """
    def distinct_values(df, side):
        names = ", ".join(f"'{c}', {c}" for c in columns)
        return (df.select(F.expr(f"stack({len(columns)}, {names}) as (column_name, value)"))
                .distinct().withColumn("side", F.lit(side)))

    both = distinct_values(before, "before").unionByName(distinct_values(after, "after"))
    return both.groupBy("column_name").agg(
        *[F.count(F.when(F.col("side") == side, F.col("value"))).alias(f"distinct_{side}")
          for side in ("before", "after")])


def join_sources(bureau: DataFrame, bank: DataFrame) -> DataFrame:
    """Inner join on the borrower key; columns present on both sides get a suffix."""
    shared = (set(bureau.columns) & set(bank.columns)) - {K.KEY}
    left = bureau.withColumnsRenamed({c: f"{c}_cibil" for c in shared})
    right = bank.withColumnsRenamed({c: f"{c}_bank" for c in shared})
    return left.join(right, K.KEY)


def engineer_features(df: DataFrame) -> DataFrame:
    loans, income, score = F.col("Total_TL"), F.col("NETMONTHLYINCOME"), F.col("Credit_Score")
    present = set(df.columns)
    types = [c for c in K.LOAN_TYPE_COUNTS if c in present]
    severity = [F.col(c) * w for c, w in K.DELINQUENCY_WEIGHTS.items() if c in present]
    features = {
        "active_loan_ratio": guarded_ratio(F.col("Tot_Active_TL"), loans),
        "missed_payment_ratio": guarded_ratio(F.col("Tot_Missed_Pmnt"), loans),
        "credit_history_months": F.col("Age_Oldest_TL"),
        "score_per_income_lakh": guarded_ratio(score, income / F.lit(100000.0)),
        "income_tier": bands.income_tier(income),
        "delinquency_score": total(severity) if severity else F.lit(0),
        "recently_active": (flag(F.col("Total_TL_opened_L6M") > 0)
                            if "Total_TL_opened_L6M" in present else F.lit(0)),
        "cibil_band": bands.score_band(score),
        "grade_band": mapped(F.col("Approved_Flag"), K.GRADE_BAND, "Unknown"),
    }
    if types:
        features["loan_type_diversity"] = total(flag(F.col(c) > 0) for c in types)
    return df.withColumns(features)


def interaction_features(df: DataFrame) -> DataFrame:
    """Four products of the base features: pace, rate, acceleration and severity."""
    def num(name):
        return F.col(name).cast("double")

    features = {
        "enq_per_credit_year": (("enq_L6m", "Age_Oldest_TL"),
                                lambda e, h: e / (h / F.lit(12.0) + F.lit(1.0))),
        "delinquency_rate": (("num_times_delinquent", "Total_TL"),
                             lambda d, t: d / (t + F.lit(1.0))),
        "enq_acceleration": (("enq_L6m", "enq_L12m"),
                             lambda e, y: F.when(e.isNull() | y.isNull(), None)
                             .otherwise(at_least_zero(e - y / F.lit(2.0)))),
        "severe_delinquency_ratio": (("num_times_60p_dpd", "num_times_delinquent"),
                                     lambda s, d: s / (d + F.lit(1.0))),
    }
    return df.withColumns({name: build(*map(num, inputs))
                           for name, (inputs, build) in features.items()
                           if all(c in df.columns for c in inputs)})


def silver_master(bank: DataFrame, bureau: DataFrame) -> DataFrame:
    """The whole step. The target is encoded before, and bands are cut after, the marker is gone."""
    clean_bureau = (bureau.transform(drop_metadata).transform(encode_target)
                    .transform(clean_sentinels).transform(clean_categories))
    clean_bank = bank.transform(drop_metadata).transform(clean_sentinels)
    return join_sources(clean_bureau, clean_bank).transform(engineer_features)


def borrowers(silver: DataFrame) -> DataFrame:
    return silver.withColumn("borrower_id", F.col(K.KEY))


def delinquency_summary(silver: DataFrame) -> DataFrame:
    """Every column whose name speaks of delays, and the target."""
    delays = [c for c in matching_columns(silver, K.DELINQUENCY_SUMMARY_PATTERNS) if c != K.TARGET]
    return silver.select(F.col(K.KEY).alias("borrower_id"), *delays, K.TARGET)


def risk_segments(silver: DataFrame) -> DataFrame:
    extreme = (F.col("enq_L6m") >= 4) & (F.col("Age_Oldest_TL") < 24)
    high = (F.col("enq_L6m") >= 3) | (F.col("num_times_60p_dpd") >= 1)
    first, second, last = K.RISK_SEGMENTS
    segment = F.when(extreme, first).when(high, second).otherwise(last)
    return silver.select(F.col(K.KEY).alias("borrower_id"), segment.alias("risk_segment"), K.TARGET,
                         "AGE", "NETMONTHLYINCOME")


# the three tables the report library reads, all keyed by ``borrower_id``
OPERATIONAL = {"borrowers": borrowers, "delinquency_summary": delinquency_summary,
               "risk_segments": risk_segments}


def operational_tables(silver: DataFrame) -> dict[str, DataFrame]:
    return {name: build(silver) for name, build in OPERATIONAL.items()}
