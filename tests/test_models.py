import pytest
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.operators import clustering, modelling


@pytest.fixture(scope="module")
def matrix(book):
    return modelling.feature_matrix(book.silver()).cache()


def test_feature_matrix(book, matrix):
    assert modelling.model_inputs(matrix) == list(K.FEATURES)
    wide = modelling.feature_matrix(book.silver(), engineered=True)
    assert modelling.model_inputs(wide) == [*K.FEATURES, *K.ENGINEERED_FEATURES]
    holes = book.silver().withColumn("AGE", F.when(F.col(K.KEY) % 5 != 0, F.col("AGE"))).drop("Gold_TL")
    filled = modelling.feature_matrix(holes)
    assert filled.where(F.col("AGE").isNull()).count() == 0 and "Gold_TL" not in filled.columns


def test_split_is_stable_and_complete(matrix):
    train, test = modelling.train_test(matrix)
    again = modelling.train_test(matrix.repartition(7))[1]
    keys = lambda df: {r[0] for r in df.select(K.KEY).collect()}
    assert keys(test) == keys(again)
    assert not keys(train) & keys(test) and len(keys(train) | keys(test)) == matrix.count()


def test_scores_are_probabilities_even_for_bad_input(spark, matrix):
    model = modelling.fit_weighted(matrix, modelling.natural_weight(matrix), trees=3)
    scored = modelling.score(matrix, model)
    low, high = scored.agg(F.min("predicted_pd"), F.max("predicted_pd")).first()
    assert 0.0 <= low < high <= 1.0 and scored.count() == matrix.count()
    bad = spark.createDataFrame([("12", float("inf")), ("abc", float("nan")), (None, None)], "AGE string, enq_L6m double")
    out = modelling.score(bad, model)
    assert out.count() == 3 and out.where("predicted_pd is null").count() == 0
    assert out.columns[:2] == ["AGE", "enq_L6m"]


def test_engineered_inputs_are_computed_before_scoring(book):
    wide = modelling.feature_matrix(book.silver(), engineered=True)
    model = modelling.fit_weighted(wide, 1.43, trees=3)
    direct = {r[K.KEY]: r["predicted_pd"] for r in modelling.score(wide, model).collect()}
    later = {r[K.KEY]: r["predicted_pd"] for r in modelling.score(book.silver(), model).collect()}
    assert direct == later


def test_evaluation_and_record(book):
    model, metrics = modelling.train_and_evaluate(book.silver(), trees=3)
    row = modelling.metrics_record(metrics, len(modelling.input_features(model))).first()
    assert 0.0 <= row["test_auc"] <= 1.0 and row["n_features"] == 15
    assert sum(map(sum, row["confusion_matrix"])) == row["n_test"]


def test_sweep_comparison_and_tuned_model(book):
    sweep = modelling.weight_sweep(book.silver(), trees=2, multiples=(0.5, 1.0)).cache()
    assert sweep.count() == 2
    best = modelling.best_weight(sweep).first()
    assert best["scale_pos_weight"] in {r["scale_pos_weight"] for r in sweep.collect()}
    rows = {r["variant"]: r for r in modelling.tuned_model(book.silver(), threshold=0.62, trees=2)[1].collect()}
    assert rows["default"]["fewer_false_alarms"] == rows["default"]["fp"] - rows["tuned"]["fp"]
    assert rows["default"]["more_misses"] == rows["tuned"]["fn"] - rows["default"]["fn"]
    compared = {r["model"]: r for r in modelling.model_comparison(book.silver(), trees=2).collect()}
    assert compared["Credit Score Only"]["leakage_suspected"] and compared["Credit Score Only"]["features"] == 1
    assert not compared["Behavioural Model (15 features)"]["leakage_suspected"]


def test_tuned_model_takes_the_weight_of_the_sweep(spark, folder, book, monkeypatch):
    from loanloom.operators import scoring
    from loanloom.plans import queries
    kinds = "scale_pos_weight double, precision double, recall double, f1 double, auc double"
    monkeypatch.setattr(queries, "_sweep", lambda df: spark.createDataFrame([(1.43, 0.5, 0.8, 0.6, 0.9), (3.25, 0.7, 0.8, 0.7, 0.9)], kinds))
    fit, models = modelling.fit_weighted, {}
    monkeypatch.setattr(modelling, "fit_weighted", lambda rows, w, trees: models.setdefault(w, fit(rows, w, 2)))
    told = {r["variant"]: r for r in queries.QUERIES["tuned_model"](spark, folder).collect()}
    assert list(models) == [3.25] and told["default"]["threshold"] == K.DECISION_THRESHOLD
    _, test = modelling.train_test(modelling.feature_matrix(book.silver(), engineered=True))
    found = scoring.best_threshold(scoring.threshold_sweep(modelling.score(test, models[3.25]))).collect()
    assert told["tuned"]["threshold"] == next(r["threshold"] for r in found if r["rule"] == "best_precision")


def test_best_weight_rules(spark):
    kinds = "scale_pos_weight double, precision double, recall double, f1 double, auc double"
    some = spark.createDataFrame([(1.0, 0.6, 0.8, 0.7, 0.9), (2.0, 0.7, 0.7, 0.7, 0.9), (3.0, 0.9, 0.6, 0.72, 0.9)], kinds)
    assert modelling.best_weight(some).first()["scale_pos_weight"] == 2.0
    none = some.withColumn("recall", F.lit(0.1))
    assert modelling.best_weight(none).first()["scale_pos_weight"] == 3.0


def test_cross_validation(matrix):
    found = modelling.cross_validate(matrix, trees=2, folds=2)
    assert 0.0 <= found["cv_auc_mean"] <= 1.0 and found["cv_auc_std"] >= 0.0


def test_attributions_add_up(matrix):
    from pyspark.ml.functions import vector_to_array
    model = modelling.logistic_model(matrix)
    told = modelling.attributions(model.transform(matrix), model)
    parts = sum((F.col(f"phi_{c}") for c in K.FEATURES), F.col("phi_base"))
    margin = vector_to_array("rawPrediction")[1]
    assert told.select(F.max(F.abs(parts - margin))).first()[0] < 1e-9
    ranked = modelling.importance(told, K.FEATURES).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 16))
    assert ranked[0]["mean_abs_attribution"] >= ranked[-1]["mean_abs_attribution"]


def test_clusters(book):
    fact = book.gold("fact_credit_risk")
    assigned = clustering.assign_clusters(fact, counts=(3, 4), restarts=2)
    profiles = clustering.cluster_profiles(assigned).orderBy(F.desc("avg_cibil")).collect()
    assert sum(r["n_borrowers"] for r in profiles) == fact.count()
    assert [r["segment_name"] for r in profiles] == list(K.CLUSTER_NAMES[:len(profiles)])
    assert len(profiles) in (3, 4)
