"""Pooled k-means against a plain one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions import blocks
from loanloom.operators import clustering


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(1)
    return np.concatenate([rng.normal(c, 0.4, size=(150, 6)) for c in (-2.0, 0.5, 3.0)])


@pytest.fixture(scope="module")
def rows(spark, table):
    return blocks.matrix_blocks(spark.createDataFrame(table.tolist(), [f"f{i}" for i in range(6)]).repartition(3),
                                [f"f{i}" for i in range(6)], 10 ** 7).cache()


def plain(table, centres):
    for _ in range(300):
        label = ((table[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([table[label == i].mean(axis=0) if (label == i).any() else c for i, c in enumerate(centres)])
        if ((new - centres) ** 2).sum() <= 1e-4:
            break
        centres = new
    return centres, ((table[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)


def plain_silhouette(table, label):
    far = ((table[:, None] - table) ** 2).sum(axis=2)
    out = []
    for i, own in enumerate(label):
        same = label == own
        if same.sum() == 1:
            out.append(0.0)
            continue
        a = far[i][same].sum() / (same.sum() - 1)
        b = min(far[i][label == c].mean() for c in set(label) - {own})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_runs_and_silhouettes_equal_plain_ones(table, rows):
    starts = [table[:2], table[[0, 1, 449]], table[[0, 200, 400, 430]], np.full((3, 6), 50.0) * [[1], [2], [3]]]
    runs = clustering.settled_runs(rows, starts)
    told = clustering.silhouettes(rows, runs[:3])
    for i, (start, run) in enumerate(zip(starts, runs)):
        centres, label = plain(table, start)
        assert np.allclose(run.centres, centres)
        assert run.cost == pytest.approx(((table - centres[label]) ** 2).sum())
        assert run.sums[:, -3].tolist() == np.bincount(label, minlength=len(start)).tolist()
        if i < 3:
            assert told[i] == pytest.approx(plain_silhouette(table, label))


def test_passes_are_bounded(table, rows):
    assert len(clustering.settled_runs(rows, [table[:3]], most_passes=1)) == 1


def test_segments_do_not_depend_on_partitions(book):
    fact = book.gold("fact_credit_risk")
    one, other = (clustering.assign_clusters(df, restarts=3) for df in (fact.coalesce(1), fact.repartition(6)))
    key = lambda df: {tuple(r) for r in df.select("borrower_id", "cluster").collect()}
    assert key(one) == key(other) and set(one.columns) == {"borrower_id", K.TARGET, *K.CLUSTER_FEATURES, "cluster"}


def test_gaps_constants_and_no_rows(book):
    fact = book.gold("fact_credit_risk")
    gappy = fact.withColumn("total_loans", F.when(F.col("borrower_id") % 2 == 0, F.col("total_loans"))).withColumn("cibil_score", F.lit(700))
    scaled = clustering.standardised(gappy)
    assert scaled.count() == fact.where("borrower_id % 2 = 0").count()
    assert scaled.select(F.max(F.abs("z_cibil_score"))).first()[0] == 0.0
    assert clustering.borrower_segments(gappy, restarts=2).count() >= 1
    assert clustering.borrower_segments(fact.limit(0)).count() == 0


def test_starting_points_of_equal_rows():
    assert clustering.starting_points(np.zeros((5, 2)), 3, (1,)).shape == (3, 2)
