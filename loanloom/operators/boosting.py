"""Boosted trees, several fits in shared passes over the rows.

Rows are cut into bins once. A level of the trees then takes one pass for all fits together: every
block adds up gradients by fit, node, feature and bin, the arrays are added up, and the driver
picks the splits from sums whose size follows from fits, nodes, features and bins alone. Class
weights, folds and feature sets differ between fits at no further pass.

The scores reached so far travel with the rows: after a tree the blocks are replaced by blocks with
new scores, computed from the last ones, and every ``CHECKPOINT_TREES`` trees they are checkpointed,
so that a lost executor costs a few trees, not all. Samples of rows depend on the row's key and the tree,
so a repeated task takes the same ones.

Trees are of fixed depth. Gains and leaf values are second-order with an L2 term, as in the usual
boosting libraries; a split must leave ``least_child`` of the summed second derivatives on either side.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.book import shared_folder
from loanloom.constants import KEY, TARGET
from loanloom.functions.blocks import kept, matrix_blocks, share_ends, ship, summed
from loanloom.functions.draws import draw

DEPTH = 4
BINS = 64
STEP = 0.05
ROW_SHARE = 0.8
COLUMN_SHARE = 0.8
SMOOTHING = 1.0
LEAST_CHILD = 1.0
LEAST_GAIN = 1e-9
SEED = 42
CHECKPOINT_TREES = 25
# odd 64-bit multipliers that spread the bits of a number (fixed values of splitmix64)
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


@dataclass(frozen=True)
class Fit:
    """One of several fits: weight of the risky class, features, and the part of the rows it must not see."""

    weight: float
    features: tuple[str, ...] = ()
    left_out: int = -1


@dataclass
class BoostedTrees:
    """Trees as arrays: node ``i`` has children ``2 i + 1`` (value at most the limit) and ``2 i + 2``."""

    features: tuple[str, ...]
    edges: list[list[float]]
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    gain: np.ndarray = field(repr=False)

    def margins(self, values: np.ndarray) -> np.ndarray:
        """Log-odds of rows of feature values."""
        bins = np.stack([np.searchsorted(e, values[:, i]) for i, e in enumerate(self.edges)]).astype(np.int32)
        out, at = np.zeros(len(values)), np.arange(len(values))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            out += leaf[_routed(bins, feature, cut, DEPTH, at) - (2 ** DEPTH - 1)]
        return out

    def importances(self) -> list[float]:
        """Share of each feature in the gain of all splits."""
        total = self.gain.sum()
        return (self.gain / total if total else self.gain).tolist()

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "edges": self.edges} | {
            n: getattr(self, n).tolist() for n in ("feature", "cut", "leaf", "gain")})

    @staticmethod
    def from_json(text: str) -> BoostedTrees:
        told = json.loads(text)
        arrays = {n: np.array(told[n], dtype=kind) for n, kind in (
            ("feature", np.int64), ("cut", np.int64), ("leaf", np.float64), ("gain", np.float64))}
        return BoostedTrees(tuple(told["features"]), told["edges"], **arrays)


def _routed(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int, at: np.ndarray) -> np.ndarray:
    """Node of every row after ``depth`` splits."""
    node = np.zeros(len(at), dtype=np.int64)
    for _ in range(depth):
        node = 2 * node + 1 + (bins[feature[node], at] > cut[node])
    return node


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Upper limits of the bins: the distinct values at equal ranks, exactly, of all features in the same passes."""
    matrices = matrix_blocks(rows, features, rows.count())
    return share_ends(matrices, len(features), [i / bins for i in range(1, bins)])


def _sampled(drawn: np.ndarray, tree: int, share: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = drawn + np.uint64(tree + 1) * np.uint64(GOLDEN)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53 < share


@dataclass
class _Block:
    bins: np.ndarray       # feature x row
    risky: np.ndarray
    part: np.ndarray
    drawn: np.ndarray
    margin: np.ndarray     # fit x row


@dataclass(frozen=True)
class _Task:
    """What every pass needs: the fits, as plain numbers."""

    weights: tuple[float, ...]
    left_out: tuple[int, ...]
    bins: int

    def derivatives(self, block: _Block, k: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-block.margin[k]))
        w = np.where(block.risky, self.weights[k], 1.0)
        return w * (p - block.risky), w * np.maximum(p * (1.0 - p), 1e-16)

    def sums(self, block: _Block, level: int, tree: _Trees, share: float, number: int) -> np.ndarray:
        """Gradients and second derivatives by fit, node of the level, feature and bin."""
        nodes, features = 2 ** level, len(block.bins)
        out = np.zeros((len(self.weights), nodes, features, self.bins, 2))
        taken = _sampled(block.drawn, number, share) if share < 1.0 else np.ones(len(block.risky), dtype=bool)
        for k in range(len(self.weights)):
            rows = np.flatnonzero(taken & (block.part != self.left_out[k]))
            start = (_routed(block.bins, tree.feature[k], tree.cut[k], level, rows) - (nodes - 1)) * self.bins
            g, h = (x[rows] for x in self.derivatives(block, k))
            for f in tree.columns[k]:
                slot = start + block.bins[f, rows]
                for j, x in enumerate((g, h)):
                    out[k, :, f, :, j] = np.bincount(slot, x, nodes * self.bins).reshape(nodes, self.bins)
        return out

    def advanced(self, block: _Block, tree: _Trees) -> _Block:
        """The block with the scores after a tree; rows left out of a fit get scores as well."""
        bins, at = block.bins, np.arange(len(block.risky))
        more = [tree.leaf[k][_routed(bins, tree.feature[k], tree.cut[k], DEPTH, at) - (2 ** DEPTH - 1)]
                for k in range(len(self.weights))]
        return _Block(bins, block.risky, block.part, block.drawn, block.margin + np.array(more))


@dataclass
class _Trees:
    """A tree of every fit while it grows."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    columns: list[np.ndarray]

    @staticmethod
    def empty(columns: list[np.ndarray], bins: int) -> _Trees:
        fits, nodes = len(columns), 2 ** DEPTH - 1
        return _Trees(np.zeros((fits, nodes), dtype=np.int64), np.full((fits, nodes), bins, dtype=np.int64),
                      np.zeros((fits, nodes + 1)), columns)


def split_gains(sums: np.ndarray) -> np.ndarray:
    """Gain of cutting after each bin, from sums by ``..., bin, (gradient, second derivative)``."""
    left = np.cumsum(sums, axis=-2)
    right = left[..., -1:, :] - left

    def worth(x):
        return x[..., 0] ** 2 / (x[..., 1] + SMOOTHING)

    gain = worth(left) + worth(right) - worth(left[..., -1:, :])
    return np.where((left[..., 1] >= LEAST_CHILD) & (right[..., 1] >= LEAST_CHILD), gain, -np.inf)


def _split(sums: np.ndarray, tree: _Trees, level: int, gains: np.ndarray) -> None:
    """Choose the splits of a level; after the last one fill the leaves."""
    first = 2 ** level - 1
    for k, columns in enumerate(tree.columns):
        gain = split_gains(sums[k])
        for node in range(2 ** level):
            best = int(gain[node].argmax())
            feature, cut = divmod(best, sums.shape[3])
            total = sums[k, node, columns[0]].sum(axis=0)
            left, right = total, np.zeros(2)
            if gain[node, feature, cut] > LEAST_GAIN:
                tree.feature[k, first + node], tree.cut[k, first + node] = feature, cut
                gains[k, feature] += gain[node, feature, cut]
                left = sums[k, node, feature, :cut + 1].sum(axis=0)
                right = total - left
            if level == DEPTH - 1:
                for side, (g, h) in enumerate((left, right)):
                    tree.leaf[k, 2 * node + side] = -STEP * g / (h + SMOOTHING)


def _blocks(rows: DataFrame, features: Sequence[str], edges: list[list[float]], fits: int, part: str | None) -> RDD:
    # 52 bits of the draw are exact in a double
    ready = rows.select(F.col(TARGET).cast("double").alias("_y"), (F.col(part) if part else F.lit(-2)).alias("_part"),
                        F.shiftright(draw(F.col(KEY), SEED), 8).alias("_draw"), *features)
    limits = [np.array(e) for e in edges]

    def binned(matrix: np.ndarray) -> _Block:
        values = matrix[:, 3:]
        bins = np.stack([np.searchsorted(e, values[:, i]) for i, e in enumerate(limits)]).astype(np.uint8)
        return _Block(bins, matrix[:, 0] == 1, matrix[:, 1].astype(np.int16), matrix[:, 2].astype(np.uint64),
                      np.zeros((fits, len(matrix))))

    return matrix_blocks(ready, ["_y", "_part", "_draw", *features], rows.count()).map(binned)


def _places(fits: Sequence[Fit], features: Sequence[str]) -> list[np.ndarray]:
    where = {c: i for i, c in enumerate(features)}
    return [np.array([where[c] for c in fit.features or features]) for fit in fits]


def boost(rows: DataFrame, features: Sequence[str], fits: Sequence[Fit], trees: int, part: str | None = None) -> list[BoostedTrees]:
    """A model for every fit. ``part`` names a column of part numbers that ``left_out`` refers to.

    ``rows`` have the key, the target and complete numeric features.
    """
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None and (folder := shared_folder(spark)):
        spark.sparkContext.setCheckpointDir(folder)
    edges, places = bin_edges(rows, features), _places(fits, features)
    task = _Task(tuple(f.weight for f in fits), tuple(f.left_out for f in fits), BINS)
    state, last = kept(_blocks(rows, features, edges, len(fits), part)), None
    grown, gains = [], np.zeros((len(fits), len(features)))
    for number in range(trees):
        columns = [np.sort(np.random.default_rng([SEED, number]).permutation(p)[:max(1, round(len(p) * COLUMN_SHARE))])
                   for p in places]
        tree = _Trees.empty(columns, BINS)
        for level in range(DEPTH):
            sums = summed(state, lambda b, level=level, tree=tree, number=number: task.sums(b, level, tree, ROW_SHARE, number))
            if last is not None:
                last.unpersist()  # the pass above has computed the new blocks from these
                last = None
            _split(sums, tree, level, gains)
        grown.append(tree)
        last, state = state, _next(state, task, tree, checkpoint=(number + 1) % CHECKPOINT_TREES == 0)
    if last is not None:
        last.unpersist()
    return [BoostedTrees(tuple(features), edges, *(np.array([getattr(t, n)[k] for t in grown]) for n in ("feature", "cut", "leaf")),
                         gains[k]) for k in range(len(fits))]


def _next(state: RDD, task: _Task, tree: _Trees, checkpoint: bool) -> RDD:
    """Blocks after a tree, computed by the first pass that needs them."""
    new = kept(state.map(lambda b: task.advanced(b, tree)))
    if checkpoint and state.context.getCheckpointDir():
        new.checkpoint()
    return new


def root_gains(rows: DataFrame, features: Sequence[str], fits: Sequence[Fit]) -> DataFrame:
    """Before any tree and any sampling: the best first cut of every feature, for every class weight."""
    edges = bin_edges(rows, features)
    task = _Task(tuple(f.weight for f in fits), tuple(f.left_out for f in fits), BINS)
    tree = _Trees.empty(_places(fits, features), BINS)
    sums = summed(_blocks(rows, features, edges, len(fits), None), lambda b: task.sums(b, 0, tree, 1.0, 0))
    gain = np.round(split_gains(sums)[:, 0], 9)
    found = [(float(fit.weight), c, float(edges[i][cut]), float(gain[k, i, cut]))
             for k, fit in enumerate(fits) for i, c in enumerate(features)
             for cut in [int(gain[k, i].argmax())] if np.isfinite(gain[k, i, cut]) and cut < len(edges[i])]
    return rows.sparkSession.createDataFrame(found, "scale_pos_weight double, feature string, cut double, gain double")


def probabilities(spark: SparkSession, models: Sequence[BoostedTrees]) -> Column:
    """Probability of the risky class by every model, as an array over the feature columns, in one pass."""
    names = models[0].features
    if any(m.features != names for m in models):
        raise ValueError("models scored together need the same features")

    @F.pandas_udf("array<double>")
    def score(*columns: pd.Series) -> pd.Series:
        values = np.column_stack(columns)
        margins = np.stack([m.margins(values) for m in models], axis=1)
        return pd.Series(list(1.0 / (1.0 + np.exp(-margins))))

    ship(spark)
    return score(*[F.col(c) for c in names])
