"""Borrower segments by k-means, all numbers of clusters and all restarts in shared passes.

One pass assigns every row under every run and adds up the rows of each (run, centre); the driver moves
the centres and asks for the next pass until no run moves. The runs of all numbers of clusters are judged by the
silhouette of squared distances, which needs one more pass: the mean distance to a cluster follows from
the cluster's size, sum and sum of squares.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions.blocks import kept, matrix_blocks, summed
from loanloom.functions.draws import draw

SEED = 42
# rows, those of the smallest draws, from which starting points are taken; all rows take part in all passes
START_ROWS = 1000
MOST_PASSES = 300
TOLERANCE = 1e-4
SCALED = "z_"


def scaled_names(features: Sequence[str] = K.CLUSTER_FEATURES) -> list[str]:
    return [f"{SCALED}{c}" for c in features]


def standardised(fact: DataFrame, features: Sequence[str] = K.CLUSTER_FEATURES) -> DataFrame:
    """Complete rows and, as ``z_`` columns, their features scaled to mean 0 and deviation 1.

    A feature that does not vary becomes 0.
    """
    complete = fact.select("borrower_id", K.TARGET, *features).dropna(subset=list(features))
    seen = complete.agg(*[x for c in features for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    return complete.withColumns({f"{SCALED}{c}": (F.col(c).cast("double") - F.lit(seen[f"m_{c}"])) / F.lit(seen[f"s_{c}"])
                                 if seen[f"s_{c}"] else F.lit(0.0) for c in features})


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((rows ** 2).sum(axis=1)[:, None] - 2 * rows @ centres.T) + (centres ** 2).sum(axis=1)


def pooled_sums(blocks: RDD, runs: Sequence[np.ndarray]) -> np.ndarray:
    """By run and centre: sums of the rows nearest to it, their number, their squares and their distances."""
    most, width = max(len(c) for c in runs), runs[0].shape[1]

    def of(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(runs), most, width + 3))
        squares = (rows ** 2).sum(axis=1)
        for r, centres in enumerate(runs):
            far = _distances(rows, centres)
            near = far.argmin(axis=1)
            best = np.maximum(far[np.arange(len(rows)), near], 0.0)
            columns = (*rows.T, np.ones(len(rows)), squares, best)
            out[r] = np.stack([np.bincount(near, c, most) for c in columns], axis=1)
        return out

    return summed(blocks, of)


def moved(runs: Sequence[np.ndarray], sums: np.ndarray) -> list[np.ndarray]:
    """Centres at the means of their rows; one without rows stays."""
    return [np.where(s[:len(c), -3:-2] > 0, s[:len(c), :-3] / np.maximum(s[:len(c), -3:-2], 1.0), c) for c, s in zip(runs, sums)]


@dataclass(frozen=True)
class Run:
    """Centres that no longer move, and the sums of their rows."""

    centres: np.ndarray
    sums: np.ndarray

    @property
    def cost(self) -> float:
        return float(self.sums[:, -1].sum())


def settled_runs(blocks: RDD, starts: Sequence[np.ndarray], most_passes: int = MOST_PASSES) -> list[Run]:
    """Every run from its starting centres until it moves less than ``TOLERANCE``, or ``most_passes`` are over."""
    runs = list(starts)
    for _ in range(most_passes):
        sums = pooled_sums(blocks, runs)
        new = moved(runs, sums)
        still = all(((a - b) ** 2).sum() <= TOLERANCE for a, b in zip(runs, new))
        if still:
            break
        runs = new
    else:
        sums = pooled_sums(blocks, runs)
    return [Run(c, s[:len(c)]) for c, s in zip(runs, sums)]


def silhouettes(blocks: RDD, runs: Sequence[Run]) -> list[float]:
    """Mean silhouette of each run over all rows, with squared distances; a row alone in its cluster counts 0."""
    def of(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(runs), 2))
        squares, at = (rows ** 2).sum(axis=1), np.arange(len(rows))
        for r, run in enumerate(runs):
            n = run.sums[:, -3]
            size = np.maximum(n, 1.0)
            near = _distances(rows, run.centres).argmin(axis=1)
            mean = squares[:, None] + run.sums[:, -2] / size - 2 * rows @ (run.sums[:, :-3] / size[:, None]).T
            own = mean[at, near] * n[near] / np.maximum(n[near] - 1, 1.0)
            mean[at, near] = np.inf
            mean[:, n == 0] = np.inf
            other = mean.min(axis=1)
            value = np.where((n[near] > 1) & np.isfinite(other), (other - own) / np.maximum(np.maximum(other, own), 1e-300), 0.0)
            out[r] = value.sum(), len(rows)
        return out

    return [float(s / n) if n else 0.0 for s, n in summed(blocks, of)]


def starting_points(sample: np.ndarray, k: int, seed: Sequence[int]) -> np.ndarray:
    """k rows of a sample, each drawn with weight by its squared distance from those before."""
    rng = np.random.default_rng(seed)
    chosen = [sample[rng.integers(len(sample))]]
    while len(chosen) < k:
        far = np.maximum(_distances(sample, np.array(chosen)).min(axis=1), 0.0)
        weights = far / far.sum() if far.sum() > 0 else None
        chosen.append(sample[rng.choice(len(sample), p=weights)])
    return np.array(chosen)


def start_sample(scaled: DataFrame, names: Sequence[str]) -> np.ndarray:
    """At most ``START_ROWS`` rows, the same whatever the partitioning."""
    drawn = scaled.select(draw(F.col("borrower_id"), SEED).alias("_draw"), *names).orderBy("_draw", *names).limit(START_ROWS)
    return np.array([row[1:] for row in drawn.collect()], dtype=np.float64).reshape(-1, len(names))


def nearest(names: Sequence[str], centres: np.ndarray) -> Column:
    """Number of the nearest centre; the first of equals."""
    def far(centre):
        parts = [(F.col(c) - F.lit(float(x))) * (F.col(c) - F.lit(float(x))) for c, x in zip(names, centre)]
        return sum(parts[1:], parts[0])
    return F.array_min(F.array(*[F.struct(far(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))["i"]


def best_centres(scaled: DataFrame, counts: Sequence[int] = K.CLUSTER_COUNTS, restarts: int = 10) -> np.ndarray | None:
    """Centres of the number of clusters with the best silhouette, each number by its cheapest run; None without rows."""
    names = scaled_names()
    sample = start_sample(scaled, names)
    if not len(sample):
        return None
    blocks = kept(matrix_blocks(scaled, names, scaled.count()))
    try:
        starts = [(k, starting_points(sample, k, (SEED, k, i))) for k in counts for i in range(restarts)]
        runs = settled_runs(blocks, [c for _, c in starts])
        cheapest = [min((run for (k, _), run in zip(starts, runs) if k == count), key=lambda run: run.cost) for count in counts]
        told = silhouettes(blocks, cheapest)
    finally:
        blocks.unpersist()
    return cheapest[told.index(max(told))].centres


def assign_clusters(fact: DataFrame, counts: Sequence[int] = K.CLUSTER_COUNTS,
                    restarts: int = 10) -> DataFrame:
    """Each borrower's cluster, with the number of clusters chosen by silhouette over all rows."""
    scaled = standardised(fact)
    centres = best_centres(scaled, counts, restarts)
    cluster = F.lit(None).cast("int") if centres is None else nearest(scaled_names(), centres)
    return scaled.withColumn("cluster", cluster).drop(*scaled_names())


def one_iteration(fact: DataFrame, starts: Sequence[float] = (-1.0, 0.0, 1.0)) -> DataFrame:
    """Centres after one pass from centres that have the same coordinate in every feature."""
    scaled, names = standardised(fact), scaled_names()
    runs = [np.array([[s] * len(names) for s in starts])]
    sums = pooled_sums(matrix_blocks(scaled, names, scaled.count()), runs)
    rows = [(i, int(s[-3]), *map(float, c)) for i, (s, c) in enumerate(zip(sums[0], moved(runs, sums)[0]))]
    return fact.sparkSession.createDataFrame(rows, "centre int, n long, " + ", ".join(f"{c} double" for c in names))


def cluster_profiles(assigned: DataFrame) -> DataFrame:
    """Size, means and default rate per cluster, named from the highest mean score down."""
    means = {"avg_cibil": "cibil_score", "avg_delinquency": "delinquency_score",
             "avg_active_ratio": "active_loan_ratio", "avg_credit_history": "credit_history_months",
             "avg_income": "monthly_income_inr", "avg_total_loans": "total_loans"}
    grouped = assigned.groupBy("cluster").agg(
        F.count("*").alias("n_borrowers"), *[F.avg(c).alias(n) for n, c in means.items()],
        (F.avg(K.TARGET) * 100).alias("default_rate_pct"))
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc("avg_cibil"), "cluster"))
    names = F.array(*[F.lit(n) for n in K.CLUSTER_NAMES])
    return grouped.withColumn("segment_name", F.get(names, place - 1))


def borrower_segments(fact: DataFrame, restarts: int = 10) -> DataFrame:
    return cluster_profiles(assign_clusters(fact, restarts=restarts))
