"""Shared-pass boosting against a plain one, exact splits, and round trips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions import blocks, draws
from loanloom.operators import boosting, modelling
from loanloom.sources import sinks

FEATURES = ("a", "b", "c")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    table = [(i, float(rng.random() < 0.2 + 0.5 * (x[0] > 0.3) * (x[1] < 1)), *map(float, x), int(i % 3))
             for i, x in enumerate(np.round(rng.normal(size=(900, 3)), 2))]
    return spark.createDataFrame(table, f"{K.KEY} long, {K.TARGET} double, a double, b double, c double, part int").repartition(4).cache()


def plain_trees(rows, fit, trees):
    """The same learner without blocks, passes or bins: every cut is tried on the rows themselves."""
    table = rows.select(K.KEY, K.TARGET, *FEATURES, "part", F.shiftright(draws.draw(F.col(K.KEY), boosting.SEED), 8).alias("d")).toPandas()
    edges = [sorted(set(np.sort(table[c])[[math.ceil(i / 64 * len(table)) - 1 for i in range(1, 64)]])) for c in FEATURES]
    y, margin = table[K.TARGET].to_numpy(), np.zeros(len(table))
    where = [FEATURES.index(c) for c in fit.features or FEATURES]
    x = table[list(FEATURES)].to_numpy()
    for number in range(trees):
        columns = np.sort(np.random.default_rng([boosting.SEED, number]).permutation(where)[:max(1, round(len(where) * 0.8))])
        taken = boosting._sampled(table["d"].to_numpy().astype(np.uint64), number, 0.8) & (table["part"].to_numpy() != fit.left_out)
        p = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, fit.weight, 1.0)
        g, h = w * (p - y), w * p * (1 - p)

        def grow(inside, depth):
            at = inside & taken
            def worth(m):
                return g[m].sum() ** 2 / (h[m].sum() + 1)
            best = (1e-9, None)
            for f in columns if depth < 4 else ():
                for cut in edges[f]:
                    low, high = at & (x[:, f] <= cut), at & (x[:, f] > cut)
                    if h[low].sum() >= 1 and h[high].sum() >= 1:
                        gain = worth(low) + worth(high) - worth(at)
                        if gain > best[0] + 1e-12:
                            best = (gain, (f, cut))
            if best[1] is None:
                margin[inside] += -0.05 * g[at].sum() / (h[at].sum() + 1)
            else:
                f, cut = best[1]
                grow(inside & (x[:, f] <= cut), depth + 1)
                grow(inside & (x[:, f] > cut), depth + 1)
        grow(np.ones(len(table), dtype=bool), 0)
    return dict(zip(table[K.KEY], 1 / (1 + np.exp(-margin))))


FITS = [boosting.Fit(1.0), boosting.Fit(2.5, left_out=1), boosting.Fit(0.7, ("a",))]


@pytest.fixture(scope="module")
def models(rows):
    return boosting.boost(rows, FEATURES, FITS, 6, "part")


@pytest.mark.parametrize("k", range(3))
def test_equals_plain_boosting(rows, models, k):
    scored = rows.select(K.KEY, boosting.probabilities(rows.sparkSession, models)[k].alias("p")).collect()
    want = plain_trees(rows, FITS[k], 6)
    assert max(abs(r["p"] - want[r[K.KEY]]) for r in scored) < 1e-9


def test_fits_do_not_depend_on_each_other_or_on_partitions(rows, models):
    alone = boosting.boost(rows.repartition(2), FEATURES, FITS[1:2], 6, "part")[0]
    assert (alone.feature == models[1].feature).all() and (alone.cut == models[1].cut).all()
    assert np.allclose(alone.leaf, models[1].leaf, atol=1e-12)


def test_small_blocks_and_checkpoints(rows, models, monkeypatch):
    monkeypatch.setattr(boosting, "CHECKPOINT_TREES", 2)
    monkeypatch.setattr(blocks, "PARTITION_BYTES", 5000)
    again = boosting.boost(rows, FEATURES, FITS, 6, "part")
    assert np.allclose(again[0].leaf, models[0].leaf, atol=1e-12)


def test_only_a_fits_features_are_used(models):
    assert models[2].importances()[1:] == [0.0, 0.0] and sum(models[0].importances()) == pytest.approx(1.0)


def test_left_out_rows_do_not_count(rows, models):
    other = rows.withColumn(K.TARGET, F.when(F.col("part") == 1, 1 - F.col(K.TARGET)).otherwise(F.col(K.TARGET)))
    again = boosting.boost(other, FEATURES, FITS[1:2], 6, "part")[0]
    assert np.allclose(again.leaf, models[1].leaf, atol=1e-12)


def test_json_and_store_round_trip(spark, rows, models, tmp_path):
    again = boosting.BoostedTrees.from_json(models[0].to_json())
    values = rows.select(*FEATURES).toPandas().to_numpy()
    assert (again.margins(values) == models[0].margins(values)).all()
    metrics = modelling.evaluate(modelling.score(rows, models[0]))
    for _ in range(2):
        sinks.save_model(models[0], str(tmp_path / "m"), models[0].features, metrics)
    found = sinks.load_model([str(tmp_path / "absent"), str(tmp_path / "m")])
    assert (found.margins(values) == models[0].margins(values)).all()


def test_one_class_and_equal_values(spark):
    one = spark.createDataFrame([(i, 0.0, 1.0, float(i)) for i in range(50)], f"{K.KEY} long, {K.TARGET} double, a double, b double")
    model = boosting.boost(one, ("a", "b"), [boosting.Fit(1.0)], 3)[0]
    assert (model.margins(np.array([[1.0, 5.0], [9.0, 80.0]])) < 0).all()


def test_exact_parts(spark):
    table = spark.createDataFrame([(i, "x" if i % 7 else "y") for i in range(1003)] + [(None, "x"), (2000, None), (5000, "z")],
                                  "k long, c string")
    part = draws.exact_parts(table, "c", "k", [0.2, 0.5], 9)
    sizes = {(r["c"], r["p"]): r["count"] for r in table.groupBy("c", part.alias("p")).count().collect()}
    x, y = 860, 144
    assert sizes == {("x", 0): 172, ("x", 1): 258, ("x", 2): x - 430, ("y", 0): 29, ("y", 1): 43, ("y", 2): y - 72,
                     (None, 1): 1, ("z", 1): 1}
    again = table.repartition(5).groupBy("c", part.alias("p")).agg(F.sum("k").alias("s")).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in table.groupBy("c", part.alias("p")).agg(F.sum("k").alias("s")).collect()}


def test_equal_keys_stay_together(spark):
    table = spark.createDataFrame([(i % 40, "x") for i in range(400)], "k long, c string")
    parts = table.select("k", draws.exact_parts(table, "c", "k", [0.5], 1).alias("p")).distinct()
    assert parts.count() == 40


def test_first_splits_need_no_trees(book):
    found = modelling.first_splits(book.silver(), (1.0,)).collect()
    assert {r["feature"] for r in found} <= {*K.FEATURES, *K.ENGINEERED_FEATURES} and all(r["gain"] > 0 for r in found[:1])


def test_bin_limits_are_exact_beyond_the_size_of_a_sketch(spark):
    rng = np.random.default_rng(11)
    values = np.column_stack([rng.normal(size=20_001), np.round(rng.exponential(size=20_001), 2), rng.integers(0, 3, 20_001)])
    table = spark.createDataFrame([tuple(map(float, x)) for x in values], "a double, b double, c double").repartition(7)
    found = boosting.bin_edges(table, FEATURES)
    ranks = [math.ceil(i / 64 * len(values)) - 1 for i in range(1, 64)]
    assert found == [sorted(set(np.sort(values[:, i])[ranks])) for i in range(3)]


def test_blocks_use_the_cores_and_one_array_reaches_the_driver(spark, rows, monkeypatch):
    monkeypatch.setattr(blocks, "CORE_BYTES", 5000)
    found = blocks.matrix_blocks(rows, FEATURES, 900)
    assert found.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("summed", "")
    try:
        total = blocks.summed(found, lambda m: m.sum(axis=0))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    last = max(s for j in jobs.getJobIdsForGroup("summed") for s in jobs.getJobInfo(j).stageIds)
    assert jobs.getStageInfo(last).numTasks == 1
    assert np.allclose(total, [sum(r[c] for r in rows.collect()) for c in FEATURES])
