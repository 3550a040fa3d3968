"""Default-probability models: features, split, fit, evaluation, sweeps, attribution."""

from __future__ import annotations

import statistics
from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions.columns import (booleans_to_int, fixed_rows, finite_or_zero, to_number,
                                        with_missing_as_zero)
from loanloom.functions.draws import exact_parts
from loanloom.functions.ordered import fill_median
from loanloom.operators.boosting import BoostedTrees, Fit, boost, probabilities, root_gains
from loanloom.operators.scoring import auc, best_threshold, confusion_matrix, threshold_sweep
from loanloom.operators.silver import interaction_features

SEED = 42
FOLDS = 5
PD = "predicted_pd"
PART = "_part"


def available_features(df: DataFrame, wanted: Sequence[str] = K.FEATURES) -> list[str]:
    return [c for c in wanted if c in df.columns]


def feature_matrix(silver: DataFrame, features: Sequence[str] = K.FEATURES, *,
                   engineered: bool = False) -> DataFrame:
    """Key, target and numeric features; gaps take the exact median of the column."""
    wanted = list(features)
    source = booleans_to_int(silver)
    if engineered:
        source = interaction_features(source)
        wanted += K.ENGINEERED_FEATURES
    names = available_features(source, wanted)
    numbers = source.select(K.KEY, F.col(K.TARGET).cast("double").alias(K.TARGET),
                            *[F.col(c).cast("double").alias(c) for c in names])
    return fill_median(numbers, names)


def model_inputs(matrix: DataFrame) -> list[str]:
    return [c for c in matrix.columns if c not in (K.KEY, K.TARGET, PART)]


def train_test(matrix: DataFrame, test_share: float = 0.2, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """A split drawn from the key, so it never changes with partitioning or a lost executor.

    The test set takes ``test_share`` of each class, rounded half up: exactly, not in expectation.
    """
    part = exact_parts(matrix, K.TARGET, K.KEY, [test_share], seed)
    return matrix.where(part == 1), matrix.where(part == 0)


def folded(train: DataFrame, folds: int = FOLDS, seed: int = SEED + 1) -> DataFrame:
    """A fold number per row; the folds of a class differ by one row at most."""
    return train.withColumn(PART, exact_parts(train, K.TARGET, K.KEY, [i / folds for i in range(1, folds)], seed))


def natural_weight(train: DataFrame) -> float:
    """Safe borrowers per risky one."""
    seen = train.agg(F.count_if(F.col(K.TARGET) == 1).alias("pos"),
                     F.count_if(F.col(K.TARGET) == 0).alias("neg")).first()
    return seen["neg"] / max(seen["pos"], 1)


def input_features(model: PipelineModel | BoostedTrees) -> list[str]:
    """The input columns a fitted model expects."""
    if isinstance(model, BoostedTrees):
        return list(model.features)
    for stage in model.stages:
        if stage.hasParam("inputCols"):
            return list(stage.getInputCols())
    raise ValueError("the pipeline has no assembler stage")


def _inputs(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` as the struct ``_row``, and its usable inputs as columns."""
    ready = df
    if any(c in K.ENGINEERED_FEATURES and c not in df.columns for c in names):
        ready = interaction_features(df)
    ready = to_number(with_missing_as_zero(ready, names), names)
    keep = ready.columns
    inputs = {f"_in_{c}": finite_or_zero(F.col(c)) for c in names}
    return ready.withColumns(inputs).select(
        F.struct(*keep).alias("_row"), *[F.col(f"_in_{c}").alias(c) for c in names])


def score(df: DataFrame, model: PipelineModel | BoostedTrees, output: str = PD) -> DataFrame:
    """Add the probability of the risky class; unusable inputs count as 0.

    Absent interaction features are computed before scoring; other absent inputs are 0.
    """
    if isinstance(model, BoostedTrees):
        return score_all(df, [model], [output])
    scored = model.transform(_inputs(df, input_features(model))).withColumn(output, vector_to_array("probability")[1])
    return scored.select("_row.*", output)


def score_all(df: DataFrame, models: Sequence[BoostedTrees], outputs: Sequence[str]) -> DataFrame:
    """One column of probabilities per model, from one pass over the rows."""
    frame = _inputs(df, models[0].features)
    found = frame.select("_row", probabilities(df.sparkSession, models).alias("_pd"))
    return found.select("_row.*", *[F.get("_pd", F.lit(i)).alias(name) for i, name in enumerate(outputs)])


@contextmanager
def held(*frames: DataFrame):
    """Keep training rows for the passes of a fit; blocks may go to disk and are rebuilt if lost."""
    kept = [f.persist(StorageLevel.MEMORY_AND_DISK) for f in frames]
    try:
        yield kept
    finally:
        for f in kept:
            f.unpersist()


def fit_weighted(train: DataFrame, positive_weight: float, trees: int = 300) -> BoostedTrees:
    return boost(train, model_inputs(train), [Fit(positive_weight)], trees)[0]


def _fold_fits(weight: float, folds: int) -> list[Fit]:
    return [Fit(weight, left_out=i) for i in range(folds)]


def _fold_aucs(train: DataFrame, models: Sequence[BoostedTrees]) -> dict[str, float]:
    """Exact AUC of every fold by the model that has not seen it; all models score in one pass."""
    names = [f"_pd_{i}" for i in range(len(models))]
    own = F.get(F.array(*names), F.col(PART))
    with held(score_all(train, models, names).select(K.TARGET, PART, own.alias(PD))) as (scored,):
        found = [auc(scored.where(F.col(PART) == i)).first()["auc"] for i in range(len(models))]
    return {"cv_auc_mean": statistics.fmean(found), "cv_auc_std": statistics.pstdev(found)}


def cross_validate(train: DataFrame, trees: int = 300, folds: int = FOLDS) -> dict[str, float]:
    """Mean and spread of the exact AUC over folds; all folds grow in the same passes."""
    with held(folded(train, folds)) as (rows,):
        models = boost(rows, model_inputs(train), _fold_fits(natural_weight(rows), folds), trees, PART)
        return _fold_aucs(rows, models)


def evaluate(scored: DataFrame, threshold: float = K.DECISION_THRESHOLD) -> DataFrame:
    """AUC, precision, recall, F1 and the four counts, as one row."""
    return confusion_matrix(scored, threshold=threshold).withColumn(
        "auc", auc(scored).select("auc").scalar())


def train_and_evaluate(silver: DataFrame, trees: int = 300, with_folds: bool = False) -> tuple[BoostedTrees, DataFrame]:
    train, test = train_test(feature_matrix(silver))
    with held(folded(train)) as (rows,):
        weight = natural_weight(rows)
        fits = [Fit(weight), *(_fold_fits(weight, FOLDS) if with_folds else [])]
        model, *others = boost(rows, model_inputs(train), fits, trees, PART)
        extra = _fold_aucs(rows, others) if others else {}
    with held(score(test, model).select(K.TARGET, PD)) as (scored,):
        metrics = _told(evaluate(scored))
    return model, metrics.withColumns({k: F.lit(v) for k, v in extra.items()})


def _told(result: DataFrame) -> DataFrame:
    """A few rows of measures, computed now: the rows they come from may be let go."""
    return result.sparkSession.createDataFrame(result.collect(), result.schema)


def metrics_record(metrics: DataFrame, n_features: int) -> DataFrame:
    """Metrics in the shape of the saved file."""
    def rounded(name):
        return F.round(F.col(name), 4) if name in metrics.columns else F.lit(None).cast("double")

    matrix = F.array(F.array("tn", "fp"), F.array("fn", "tp"))
    return metrics.select(
        rounded("auc").alias("test_auc"), rounded("precision").alias("test_precision"),
        rounded("recall").alias("test_recall"), rounded("f1").alias("test_f1"),
        rounded("cv_auc_mean").alias("cv_auc_mean"), rounded("cv_auc_std").alias("cv_auc_std"),
        (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n_test"),
        F.lit(n_features).cast("long").alias("n_features"), matrix.alias("confusion_matrix"))


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


class Sweep(NamedTuple):
    """Measures per class weight, and the models they belong to."""

    table: DataFrame
    models: dict[float, BoostedTrees]


def sweep_weights(train: DataFrame, multiples: Sequence[float] = K.WEIGHT_MULTIPLES) -> list[float]:
    """Multiples of the natural class weight."""
    natural = natural_weight(train)
    return sorted({round(natural * m, 2) for m in multiples})


def sweep(silver: DataFrame, trees: int = 300, multiples: Sequence[float] = K.WEIGHT_MULTIPLES) -> Sweep:
    """All weights grow in the same passes and score the test rows in one."""
    train, test = train_test(feature_matrix(silver, engineered=True))
    with held(train) as (rows,):
        weights = sweep_weights(rows, multiples)
        models = boost(rows, model_inputs(rows), [Fit(w) for w in weights], trees)
    names = [f"_pd_{i}" for i in range(len(weights))]
    with held(score_all(test, models, names)) as (scored,):
        found = [evaluate(scored.withColumn(PD, F.col(name))).select("precision", "recall", "f1", "auc").first() for name in names]
    measured = fixed_rows(silver.sparkSession, "scale_pos_weight double, precision double, recall double, f1 double, auc double",
                          [(w, *row) for w, row in zip(weights, found)])
    return Sweep(measured, dict(zip(weights, models)))


def weight_sweep(silver: DataFrame, trees: int = 300, multiples: Sequence[float] = K.WEIGHT_MULTIPLES) -> DataFrame:
    """Precision, recall, F1 and AUC for multiples of the natural class weight."""
    return sweep(silver, trees, multiples).table


def first_splits(silver: DataFrame, multiples: Sequence[float] = K.WEIGHT_MULTIPLES) -> DataFrame:
    """Where the sweep's models would first cut every feature, and what that gains, for every class weight."""
    train, _ = train_test(feature_matrix(silver, engineered=True))
    with held(train) as (rows,):
        return root_gains(rows, model_inputs(rows), [Fit(w) for w in sweep_weights(rows, multiples)])


def best_weight(sweep: DataFrame, min_recall: float = K.WEIGHT_MIN_RECALL) -> DataFrame:
    """Best precision with enough recall, else best F1; the smallest weight on ties."""
    row = F.struct(*sweep.columns)
    enough = F.col("recall") >= min_recall

    def rank_by(name):
        return F.struct(F.col(name), -F.col("scale_pos_weight"))

    best = F.coalesce(F.max_by(F.when(enough, row), F.when(enough, rank_by("precision"))),
                      F.max_by(row, rank_by("f1")))
    return sweep.agg(best.alias("b")).select("b.*")


def tuned_model(silver: DataFrame, weight: float = K.TUNED_CLASS_WEIGHT,
                threshold: float | None = K.DECISION_THRESHOLD, trees: int = 300,
                model: BoostedTrees | None = None) -> tuple[BoostedTrees, DataFrame]:
    """The 19-feature model at one class weight: metrics at the default and a tuned cut-off.

    A ``model`` that was fitted at this weight already is taken as it is. Without a ``threshold`` the tuned one is the most precise with enough recall on the model's own scores.
    The change in false alarms and misses is stated on both rows.
    """
    train, test = train_test(feature_matrix(silver, engineered=True))
    if model is None:
        with held(train) as (rows,):
            model = fit_weighted(rows, weight, trees)
    with held(score(test, model).select(K.TARGET, PD)) as (scored,):
        if threshold is None:
            found = best_threshold(threshold_sweep(scored)).where("rule = 'best_precision'").first()["threshold"]
            threshold = K.DECISION_THRESHOLD if found is None else found
        both = _told(_union([evaluate(scored, t).select(F.lit(name).alias("variant"), F.lit(float(t)).alias("threshold"), "*")
                             for name, t in (("default", K.DECISION_THRESHOLD), ("tuned", threshold))]))

    def change(name):
        of = {v: F.max(F.when(F.col("variant") == v, F.col(name))).over(Window.partitionBy())
              for v in ("default", "tuned")}
        return of["default"] - of["tuned"]

    return model, both.withColumns({"fewer_false_alarms": change("fp"),
                                    "more_misses": -change("fn")})


def model_comparison(silver: DataFrame, trees: int = 200) -> DataFrame:
    """Bureau score alone, behaviour alone, both: AUC, F1 and a leakage mark."""
    behaviour = available_features(silver)
    # ---- fixed values: names of the three variants
    variants = (("Credit Score Only", [K.SCORE_FEATURE]),
                (f"Behavioural Model ({len(behaviour)} features)", behaviour),
                ("Combined (Score + Behaviour)", [*behaviour, K.SCORE_FEATURE]))
    train, test = train_test(feature_matrix(silver, [*behaviour, K.SCORE_FEATURE]))
    with held(train) as (rows,):
        weight = natural_weight(rows)
        models = boost(rows, model_inputs(rows), [Fit(weight, tuple(features)) for _, features in variants], trees)
    names = [f"_pd_{i}" for i in range(len(variants))]
    with held(score_all(test, models, names)) as (scored,):
        found = [evaluate(scored.withColumn(PD, F.col(name))).select("auc", "f1").first() for name in names]
    measured = fixed_rows(silver.sparkSession, "model string, features int, auc double, f1 double",
                          [(name, len(features), *row) for (name, features), row in zip(variants, found)])
    return measured.withColumn("leakage_suspected", (F.col("features") == 1) & (F.col("auc") > K.LEAKAGE_AUC))


def logistic_model(matrix: DataFrame, features: Sequence[str] | None = None) -> PipelineModel:
    """Linear log-odds model on standardised inputs."""
    names = list(features or model_inputs(matrix))
    return Pipeline(stages=[
        VectorAssembler(inputCols=names, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(featuresCol="features", labelCol=K.TARGET, regParam=1e-4, maxIter=50),
    ]).fit(matrix)


def linear_attributions(df: DataFrame, card: Mapping[str, tuple[float, float]],
                        prefix: str = "phi_") -> DataFrame:
    """``phi = (x - mean) * beta`` for every feature of a card ``feature -> (beta, mean)``."""
    return df.withColumns({f"{prefix}{c}": (F.col(c).cast("double") - F.lit(float(mean))) * F.lit(float(beta))
                           for c, (beta, mean) in card.items()})


def attributions(df: DataFrame, model: PipelineModel, prefix: str = "phi_") -> DataFrame:
    """Exact additive attribution in log-odds, one column per feature.

    Together with ``phi_base`` the columns add up to the margin.
    """
    names = input_features(model)
    scaler, learner = model.stages[1], model.stages[2]
    means, spreads = scaler.mean.toArray(), scaler.std.toArray()
    betas = learner.coefficients.toArray()
    card = {c: (b / s if s else 0.0, m) for c, m, s, b in zip(names, means, spreads, betas)}
    return linear_attributions(df, card, prefix).withColumn(f"{prefix}base", F.lit(float(learner.intercept)))


def importance(attributed: DataFrame, features: Sequence[str], model: BoostedTrees | None = None,
               prefix: str = "phi_") -> DataFrame:
    """Mean absolute attribution per feature, ranked, next to the trees' own importance."""
    sizes = attributed.agg(*[F.avg(F.abs(F.col(f"{prefix}{c}"))).alias(c) for c in features])
    built_in = dict(zip(model.features, model.importances())) if model else {}
    own = fixed_rows(attributed.sparkSession, "feature string, built_in_importance double",
                     [(c, float(built_in[c]) if c in built_in else None) for c in features])
    long = sizes.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean_abs_attribution")) for c in features])))
    order = Window.partitionBy().orderBy(F.desc("mean_abs_attribution"), "feature")
    return long.join(own, "feature", "left").withColumn("rank", F.row_number().over(order))
