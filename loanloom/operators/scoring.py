"""Probability of default by rule, and how well any probability separates the classes."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions.columns import at_least_zero, count_where, fixed_rows, ratio_or_null
from loanloom.functions.ordered import range_limits, running_totals


def rule_pd() -> Column:
    """Seven clamped, weighted terms; needs no trained model.

    The missed-payment ratio counts up to 1 and the history up to 300 months; a NULL
    input counts as 0.
    """
    def num(name):
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    def share_of(name, limit):
        return F.least(num(name) / F.lit(float(limit)), F.lit(1.0))

    missed = F.least(num("missed_payment_ratio"), F.lit(1.0))
    history = F.least(num("Age_Oldest_TL"), F.lit(300.0))
    raises = (share_of("enq_L6m", 6) * 0.30 + share_of("num_times_delinquent", 10) * 0.25
              + missed * 0.20 + num("active_loan_ratio") * 0.15
              + share_of("num_times_60p_dpd", 3) * 0.10)
    lowers_history = at_least_zero((history - 24.0) / 276.0) * 0.15
    lowers_income = at_least_zero((num("NETMONTHLYINCOME") - 10000.0) / 490000.0) * 0.10
    score = raises - lowers_history - lowers_income
    return F.greatest(F.lit(0.02), F.least(F.lit(0.97), score))


def _rates(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 from tp, fp, fn; 0 where a divisor is 0."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))

    def rate(n, d):
        return F.coalesce(n / F.nullif(d, F.lit(0.0)), F.lit(0.0))

    return df.withColumns({
        "precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn),
        "f1": rate(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn)})


def confusion_matrix(df: DataFrame, score: str = "predicted_pd", label: str = K.TARGET,
                     threshold: float = K.DECISION_THRESHOLD) -> DataFrame:
    """Four counts and the derived rates at one threshold, in one pass."""
    risky, flagged = F.col(label) == 1, F.col(score) >= F.lit(float(threshold))
    counts = df.agg(count_where(flagged & risky).alias("tp"), count_where(flagged & ~risky).alias("fp"),
                    count_where(~flagged & risky).alias("fn"), count_where(~flagged & ~risky).alias("tn"))
    return _rates(counts).withColumn("accuracy", ratio_or_null(
        F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))


def class_counts(df: DataFrame, score: str, label: str = K.TARGET) -> DataFrame:
    """Positives and negatives per distinct score."""
    return (df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score"))
            .agg(count_where(F.col(label) == 1).alias("pos"),
                 count_where(F.col(label) != 1).alias("neg")))


def _auc_of(placed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    below = F.col("neg_before") + F.col("neg") / F.lit(2.0)
    return (placed.groupBy(*by)
            .agg(F.sum(F.col("pos") * below).alias("_wins"), F.sum("pos").alias("positives"),
                 F.sum("neg").alias("negatives"))
            .select(*by, "positives", "negatives", ratio_or_null(
                F.col("_wins"), F.col("positives").cast("double") * F.col("negatives")).alias("auc")))


def auc(df: DataFrame, score: str = "predicted_pd", label: str = K.TARGET) -> DataFrame:
    """Area under the ROC curve by rank sums; ties count one half."""
    return _auc_of(running_totals(class_counts(df, score, label), "score", ["neg"],
                                  limits=range_limits(df, score)))


def single_feature_auc(df: DataFrame, features: Sequence[str], label: str = K.TARGET) -> DataFrame:
    """Rank-sum AUC of every feature alone, whichever direction separates better.

    All features share one scan and one shuffle; an AUC over the limit suggests that the
    feature was derived from the target.
    """
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in features)
    long = df.select(label, F.expr(f"stack({len(features)}, {pairs}) as (feature, score)"))
    counts = (long.where(F.col("score").isNotNull()).groupBy("feature", "score")
              .agg(count_where(F.col(label) == 1).alias("pos"),
                   count_where(F.col(label) != 1).alias("neg")))
    placed = running_totals(counts, "score", ["neg"], by=["feature"], limits=range_limits(long, "score"))
    oriented = F.greatest(F.col("auc"), F.lit(1.0) - F.col("auc"))
    return _auc_of(placed, ["feature"]).withColumn("auc", oriented).withColumn(
        "leakage_suspected", F.coalesce(F.col("auc") > K.LEAKAGE_AUC, F.lit(False)))


def roc_points(df: DataFrame, score: str = "predicted_pd", label: str = K.TARGET,
               drop_collinear: bool = True) -> DataFrame:
    """ROC curve: one row per distinct score and the origin (threshold NULL).

    ``drop_collinear`` leaves out points in the middle of a straight piece: those whose
    next point repeats both the positive and the negative step.
    """
    counts = class_counts(df, score, label)
    totals = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    all_pos, all_neg = totals.select("p").scalar(), totals.select("n").scalar()
    placed = running_totals(counts, "score", ["pos", "neg"], descending=True,
                            limits=range_limits(df, score))
    if drop_collinear:
        after = placed.select(F.col("pos_before").alias("pos_done"),
                              F.col("neg_before").alias("neg_done"),
                              F.col("pos").alias("next_pos"), F.col("neg").alias("next_neg"))
        ends = placed.withColumns({"pos_done": F.col("pos_before") + F.col("pos"),
                                   "neg_done": F.col("neg_before") + F.col("neg")})
        joined = ends.join(after, ["pos_done", "neg_done"], "left")
        first = (F.col("pos_before") + F.col("neg_before")) == 0
        kept = joined.where(first | F.col("next_pos").isNull()
                            | (F.col("next_pos") != F.col("pos"))
                            | (F.col("next_neg") != F.col("neg")))
    else:
        kept = placed.withColumns({"pos_done": F.col("pos_before") + F.col("pos"),
                                   "neg_done": F.col("neg_before") + F.col("neg")})
    points = kept.select(F.col("score").alias("threshold"),
                         ratio_or_null(F.col("neg_done"), all_neg).alias("fpr"),
                         ratio_or_null(F.col("pos_done"), all_pos).alias("tpr"))
    origin = totals.select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"),
                           F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def pr_points(df: DataFrame, score: str = "predicted_pd", label: str = K.TARGET) -> DataFrame:
    """Precision and recall at every distinct score, and the closing point (1, 0)."""
    counts = class_counts(df, score, label)
    all_pos = counts.agg(F.sum("pos")).scalar()
    placed = running_totals(counts, "score", ["pos", "neg"], descending=True,
                            limits=range_limits(df, score))
    hits = F.col("pos_before") + F.col("pos")
    flagged = hits + F.col("neg_before") + F.col("neg")
    points = placed.select(F.col("score").alias("threshold"),
                           ratio_or_null(hits, flagged).alias("precision"),
                           ratio_or_null(hits, all_pos).alias("recall"))
    close = counts.agg(F.count("*").alias("_n")).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"))
    return points.unionByName(close)


def average_precision(df: DataFrame, score: str = "predicted_pd", label: str = K.TARGET) -> DataFrame:
    """Area under the precision-recall curve as the mean precision over the positives."""
    placed = running_totals(class_counts(df, score, label), "score", ["pos", "neg"], descending=True,
                            limits=range_limits(df, score))
    hits = F.col("pos_before") + F.col("pos")
    at_score = ratio_or_null(hits, hits + F.col("neg_before") + F.col("neg"))
    return placed.agg(F.sum("pos").alias("positives"),
                      ratio_or_null(F.sum(F.col("pos") * at_score), F.sum("pos")).alias("average_precision"))


def sweep_grid() -> list[float]:
    return [float(x) for x in np.arange(K.SWEEP_START, K.SWEEP_STOP, K.SWEEP_STEP)]


def counts_at_cutoffs(df: DataFrame, cutoffs: Sequence[float], score: str = "predicted_pd",
                      label: str = K.TARGET) -> DataFrame:
    """tp, fp, fn, tn for every cut-off from one scan.

    Each score falls between two neighbouring cut-offs; counts per gap (one row per
    cut-off) are then added up from the top.
    """
    grid = sorted(float(c) for c in cutoffs)
    gaps = Bucketizer(splits=[-math.inf, *grid, math.inf], inputCol=score, outputCol="gap",
                      handleInvalid="keep").transform(df.select(score, label))
    per_gap = (gaps.where(F.col(score).isNotNull())
               .groupBy((F.col("gap").cast("int") - 1).alias("step"))
               .agg(count_where(F.col(label) == 1).alias("pos"), count_where(F.col(label) != 1).alias("neg")))
    steps = fixed_rows(df.sparkSession, "step int, cutoff double",
                       list(enumerate([None, *grid], -1)))
    filled = steps.join(per_gap, "step", "left").fillna(0, ["pos", "neg"])
    upward = Window.partitionBy().orderBy(F.desc("step"))
    below = Window.partitionBy().orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    added = filled.select("cutoff", *[F.sum(c).over(upward).alias(n) for c, n in
                                      (("pos", "tp"), ("neg", "fp"))],
                          *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(n) for c, n in
                            (("pos", "fn"), ("neg", "tn"))])
    return _rates(added.where(F.col("cutoff").isNotNull()))


def threshold_table(df: DataFrame, cutoffs: Sequence[float] = K.POLICY_CUTOFFS,
                    score: str = "predicted_pd", label: str = K.TARGET) -> DataFrame:
    """Approval rate, recall, false alarms, precision and F1 by cut-off."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts_at_cutoffs(df, cutoffs, score, label).select(
        F.col("cutoff").alias("threshold"),
        (ratio_or_null(fn + tn, tp + fp + fn + tn) * 100).alias("approval_rate_pct"),
        (F.col("recall") * 100).alias("defaults_caught_pct"),
        (F.coalesce(ratio_or_null(fp, tp + fp), F.lit(0.0)) * 100).alias("false_alarm_rate_pct"),
        (F.col("precision") * 100).alias("precision_pct"),
        F.col("f1").alias("f1_score"),
        fn.alias("defaults_missed"), fp.alias("safe_borrowers_rejected"))


def threshold_display(df: DataFrame, score: str = "predicted_pd", label: str = K.TARGET) -> DataFrame:
    """The shorter grid with the current decision threshold marked, numbers as text.

    Text rounds half to even, unlike the formatter itself.
    """
    table = threshold_table(df, K.DISPLAY_CUTOFFS, score, label)

    def pct(name):
        return F.format_string("%.1f%%", F.bround(F.col(name), 1))

    current = F.abs(F.col("threshold") - K.DECISION_THRESHOLD) < 0.01
    return table.select(
        F.format_string("%.2f", F.col("threshold")).alias("threshold"),
        pct("approval_rate_pct").alias("approval"), pct("defaults_caught_pct").alias("recall"),
        pct("precision_pct").alias("precision"), pct("false_alarm_rate_pct").alias("false_alarm"),
        F.format_string("%.3f", F.bround("f1_score", 3)).alias("f1"),
        F.when(current, "◀").otherwise("").alias("current"))


def threshold_sweep(df: DataFrame, score: str = "predicted_pd", label: str = K.TARGET) -> DataFrame:
    """Precision, recall and F1 on the 81-point grid."""
    return counts_at_cutoffs(df, sweep_grid(), score, label).select(
        F.round("cutoff", 2).alias("threshold"), "precision", "recall", "f1")


def best_threshold(sweep: DataFrame, min_recall: float = K.SWEEP_MIN_RECALL) -> DataFrame:
    """Best F1, and best precision with enough recall (else best F1); first cut-off on ties."""
    row = F.struct("threshold", "precision", "recall", "f1")

    def rank_by(measure):
        return F.struct(F.col(measure), -F.col("threshold"))

    enough = F.col("recall") >= min_recall
    best_f1 = F.max_by(row, rank_by("f1"))
    best_precision = F.max_by(F.when(enough, row), F.when(enough, rank_by("precision")))
    picked = sweep.agg(best_f1.alias("best_f1"), F.coalesce(best_precision, best_f1).alias("best_precision"))
    return picked.select(F.expr(
        "stack(2, 'best_f1', best_f1, 'best_precision', best_precision) as (rule, pick)")
    ).select("rule", "pick.*")
