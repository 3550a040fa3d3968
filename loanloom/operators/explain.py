"""Plain-language reasons for a probability of default, as columns over the whole table."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom import constants as K

PD = "predicted_pd"


def _written(value: Column, form: str) -> Column:
    """A number as text in one of the forms the sentences name."""
    number = value.cast("double")
    if form == "whole":
        return number.try_cast("long").cast("string")
    if form in ("rounded", "percent"):
        return F.bround(number * 100 if form == "percent" else number, 0).try_cast("long").cast("string")
    if form == "rupees":
        return F.concat(F.lit("₹"), F.format_number(number, 0))
    raise ValueError(f"unknown form {form}")


def sentence(text: str, value: Column) -> Column:
    """Fill the forms in a fixed sentence with a column."""
    parts = re.split(r"\{(\w+)\}", text)
    pieces = [F.lit(p) if i % 2 == 0 else _written(value, p) for i, p in enumerate(parts) if p]
    return F.concat(*pieces)


def risk_sentence(feature: str, value: Column) -> Column:
    usual = sentence(K.RISK_SENTENCES[feature], value)
    if feature not in K.RISK_SENTENCE_EXCEPTIONS:
        return usual
    condition, text = K.RISK_SENTENCE_EXCEPTIONS[feature]
    return F.when(_meets(value, condition), sentence(text, value)).otherwise(usual)


def _meets(value: Column, condition: str) -> Column:
    sign, limit = condition.split()
    bound = F.lit(float(limit))
    return {"<": value < bound, ">": value > bound, ">=": value >= bound}[sign]


def risk_level(pd: Column) -> Column:
    (high, at_high), (medium, at_medium), (low, _) = K.RISK_LEVELS
    return F.when(pd >= at_high, high).when(pd >= at_medium, medium).otherwise(low)


def _by_level(pd: Column, texts: Mapping[str, str]) -> Column:
    high, medium, low = (name for name, _ in K.RISK_LEVELS)
    level = risk_level(pd)
    return F.when(level == high, texts[high]).when(level == medium, texts[medium]).otherwise(texts[low])


def recommendation(pd: Column) -> Column:
    return _by_level(pd, K.RECOMMENDATIONS)


def short_recommendation(pd: Column) -> Column:
    return _by_level(pd, K.SHORT_RECOMMENDATIONS)


def pd_percent(pd: Column) -> Column:
    return F.bround(pd * 100, 1)


def _reason(feature: str, value: Column, label: str, risky: bool) -> Column:
    if risky and feature in K.RISK_SENTENCES:
        return risk_sentence(feature, value)
    if not risky and feature in K.SAFE_SENTENCES:
        return sentence(K.SAFE_SENTENCES[feature], value)
    ending = K.OTHER_RISK_ENDING if risky else K.OTHER_SAFE_ENDING
    return F.concat(F.lit(f"{label}: "), value.cast("string"), F.lit(ending))


def _entry(feature: str, label: str, value: Column, weight: Column, risky: bool) -> Column:
    return F.struct(
        F.lit(feature).alias("feature"), F.lit(label).alias("label"),
        value.cast("double").alias("value"), F.round(weight, 3).alias("shap"),
        F.lit("risk" if risky else "safe").alias("direction"),
        _reason(feature, value, label, risky).alias("reason"))


def _keep(candidates: Sequence[Column], limit: int) -> Column:
    return F.slice(F.filter(F.array(*candidates), lambda e: e.isNotNull()), 1, limit)


def rule_reasons(df: DataFrame, top_n: int = 5) -> DataFrame:
    """Reasons from fixed limits: three that raise the risk, two that lower it."""
    def found(rules, risky):
        entries = []
        for feature, limit, weight, label, default in rules:
            value = F.col(feature) if feature in df.columns else F.lit(default)
            entries.append(F.when(value >= limit, _entry(feature, label, value, F.lit(weight), risky)))
        return _keep(entries, top_n)

    return df.withColumns({"risk_reasons": found(K.RISK_RULES, True),
                           "protective_factors": found(K.SAFE_RULES, False)})


def attribution_reasons(df: DataFrame, attributions: Mapping[str, str], top_n: int = 5) -> DataFrame:
    """Reasons from attributions: the ``2 * top_n`` largest, split by sign.

    ``attributions`` maps a feature to the column with its contribution. Contributions
    within the cut-off say nothing; equal sizes keep the given order.
    """
    entries = []
    for place, (feature, column) in enumerate(attributions.items()):
        size = F.coalesce(F.nanvl(F.col(column), F.lit(0.0)), F.lit(0.0))
        label = K.FEATURE_LABELS.get(feature, feature)
        value = F.col(feature)
        risky = F.when(size > K.ATTRIBUTION_CUTOFF, _entry(feature, label, value, size, True))
        safe = F.when(size < -K.ATTRIBUTION_CUTOFF, _entry(feature, label, value, size, False))
        entries.append(F.struct((-F.abs(size)).alias("order"), F.lit(place).alias("place"),
                                F.coalesce(risky, safe).alias("entry")))
    largest = F.slice(F.array_sort(F.array(*entries)), 1, 2 * top_n)

    def side(direction):
        chosen = F.filter(largest, lambda e: e["entry"]["direction"] == direction)
        return F.slice(F.transform(chosen, lambda e: e["entry"]), 1, top_n)

    return df.withColumns({"risk_reasons": side("risk"), "protective_factors": side("safe")})


def explain(df: DataFrame, attributions: Mapping[str, str] | None = None, top_n: int = 5) -> DataFrame:
    """Level, reasons, protective factors, recommendation and one-line summary per row."""
    reasoned = (attribution_reasons(df, attributions, top_n) if attributions
                else rule_reasons(df, top_n))
    pd = F.col(PD)
    lead, link = K.SUMMARY_SENTENCE
    first = F.coalesce(F.get(F.col("risk_reasons"), F.lit(0))["reason"], F.lit(K.NO_RISK_SIGNAL))
    return reasoned.withColumns({
        "predicted_pd_pct": pd_percent(pd), "risk_level": risk_level(pd),
        "recommendation": recommendation(pd),
        "summary": F.concat(F.lit(lead), F.format_string("%.1f", pd_percent(pd)), F.lit(link), first)})


def batch_explain(df: DataFrame, key: str = "borrower_id") -> DataFrame:
    """Compact explanation of every borrower."""
    reasoned = rule_reasons(df, top_n=1)
    pd = F.col(PD)
    first = F.get(F.col("risk_reasons"), F.lit(0))["reason"]
    short = F.concat(F.substring(recommendation(pd), 1, K.RECOMMENDATION_PREVIEW), F.lit("..."))
    return reasoned.select(key, pd_percent(pd).alias("predicted_pd_pct"), risk_level(pd).alias("risk_level"),
                           F.coalesce(first, F.lit(K.NO_REASON)).alias("primary_reason"),
                           short.alias("recommendation"))


def application_reasons(df: DataFrame, key: str = "borrower_id", limit: int = 5) -> DataFrame:
    """The scorer's list: up to five marked reasons and a short recommendation."""
    told = [F.when(_meets(F.col(c), condition), F.concat(F.lit(f"{mark}: "), sentence(text, F.col(c))))
            for mark, c, condition, text in K.APPLICATION_RULES]
    listed = _keep(told, limit)
    pd = F.col(PD)
    return df.select(key, pd_percent(pd).alias("predicted_pd_pct"), risk_level(pd).alias("risk_level"),
                     F.array_join(listed, "; ").alias("reasons"), F.size(listed).alias("reason_count"),
                     short_recommendation(pd).alias("recommendation"))
