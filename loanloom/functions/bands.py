"""Turning a numeric column into labelled bands with one CASE chain.

``Bucketizer`` is not enough here: it is left-closed only and yields numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanloom import constants as K


def cut(column: Column, edges: Sequence[float], labels: Sequence, *,
        right: bool = True, fill=None) -> Column:
    """Label the interval a value falls in; ``fill`` outside all of them and for NULL.

    ``right=True`` gives ``(a, b]`` intervals, ``right=False`` gives ``[a, b)``.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("need one edge more than labels")

    def beyond(edge):
        bound = F.lit(float(edge))
        return column <= bound if right else column < bound

    chain = F.when(column.isNull() | beyond(edges[0]), F.lit(fill))
    for edge, label in zip(edges[1:], labels):
        chain = chain.when(beyond(edge), F.lit(label))
    return chain.otherwise(F.lit(fill))


def income_tier(income: Column) -> Column:
    return cut(income, *K.INCOME_TIER, fill="nan")


def score_band(score: Column) -> Column:
    return cut(score, *K.SCORE_BAND, fill="nan")


def gold_age_band(age: Column) -> Column:
    """Open-ended age bands of the star schema; NULL counts as the last band."""
    chain = None
    for label, upper in K.GOLD_AGE_BANDS:
        chain = F.when(age < upper, label) if chain is None else chain.when(age < upper, label)
    return chain.otherwise(K.GOLD_AGE_LAST)


def score_step_start(score: Column) -> Column:
    """Lower bound of the 20-point score band; NULL outside 300..799."""
    low, high = K.SCORE_STEP_RANGE
    step = F.floor((score - low) / F.lit(float(K.SCORE_STEP))) * K.SCORE_STEP + low
    return F.when((score >= low) & (score < high), step.cast("int"))


def score_step_label(start: Column) -> Column:
    return F.concat(start.cast("string"), F.lit("-"), (start + (K.SCORE_STEP - 1)).cast("string"))


def pd_band(pd: Column) -> Column:
    """Half-open probability bands; a probability of exactly 1 is in none of them."""
    edges = [low for _, low, _ in K.PD_BANDS] + [K.PD_BANDS[-1][2]]
    return cut(pd, edges, [name for name, _, _ in K.PD_BANDS], right=False)


def _stepped(conditions: Sequence[Column], labels: Sequence[str]) -> Column:
    chain = F.when(conditions[0], labels[0])
    for condition, label in zip(conditions[1:], labels[1:]):
        chain = chain.when(condition, label)
    return chain.otherwise(labels[-1])


def enquiry_label(enquiries: Column, labels: Sequence[str] = K.ENQUIRY_LABELS) -> Column:
    """The last label also takes NULL and negative counts."""
    return _stepped([enquiries == n for n in range(4)] + [enquiries.between(4, 5)], labels)


def history_label(months: Column, labels: Sequence[str] = K.HISTORY_LABELS) -> Column:
    """Months of history; borrowers without any loan carry 9999 and land in the last band."""
    return _stepped([months < 12, months.between(12, 23), months.between(24, 47),
                     months.between(48, 95)], labels)


def income_label(income: Column, labels: Sequence[str] = K.INCOME_LABELS) -> Column:
    """Whole-rupee ranges: a fractional income between two ranges lands in the last band."""
    return _stepped([income < 10000, income.between(10000, 19999), income.between(20000, 34999),
                     income.between(35000, 59999)], labels)


def age_segment(age: Column, labels: Sequence[str] = K.AGE_SEGMENTS) -> Column:
    """The last segment also takes NULL and ages under 18."""
    return _stepped([age.between(18, 25), age.between(26, 35), age.between(36, 45),
                     age.between(46, 55)], labels)


def gold_loan_label(loans: Column, labels: Sequence[str] = K.GOLD_LOAN_LABELS) -> Column:
    return _stepped([loans == n for n in range(3)], labels)
