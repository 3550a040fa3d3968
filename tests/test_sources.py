import json
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel

from loanloom import schemas
from loanloom.book import LoanBook, shared_folder
from loanloom.operators import export, gold, modelling, reports
from loanloom.sources import catalog, ingest, sinks, tables


def test_declared_schemas(book):
    assert book.bank().schema.simpleString() == schemas.BANK.simpleString()
    assert book.bureau().schema.simpleString() == schemas.BUREAU.simpleString()


def test_csv_round_trip_with_schema(spark, book, tmp_path):
    sinks.write_csv(book.bank(), str(tmp_path / "bank.csv"))
    again = tables.read_csv(spark, str(tmp_path / "bank.csv"), schemas.BANK)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, book.bank().collect()))
    assert tables.read_sample(again, 7).count() == 7


def test_bronze_jobs(spark, book, tmp_path):
    raw = tmp_path / "raw"
    sinks.write_csv(book.bank(), str(raw / "bank.csv"))
    sinks.write_parquet(book.bureau(), str(raw / "bureau.parquet"))
    applications = spark.createDataFrame([(1, 100.0, 1.0, 10.0, 0.0, 30.0), (0, 300.0, 2.0, 20.0, 1.0, 40.5)],
                                         schemas.LOAN_APPLICATIONS)
    sinks.write_csv(applications, str(raw / "loans.csv"))
    words = spark.createDataFrame([("Approved_Flag", "P1 to P4")], schemas.DATA_DICTIONARY)
    sinks.write_csv(words, str(raw / "words.csv"))
    stored, keys = ingest.ingest_all(spark, {
        "internal_bank": str(raw / "bank.csv"), "cibil_external": str(raw / "bureau.parquet"),
        "loan_applications": str(raw / "loans.csv"), "data_dictionary": str(raw / "words.csv")}, str(tmp_path / "bronze"))
    assert keys.first()["verdict"] == "perfect"
    bank = stored["internal_bank"]
    assert bank.columns[-2:] == ["_source", "_ingested_at"]
    stamps = bank.select("_source", "_ingested_at").distinct().collect()
    assert len(stamps) == 1 and stamps[0]["_source"] == "kaggle_internal_bank" and "T" in stamps[0]["_ingested_at"]
    assert (Path(tmp_path) / "bronze" / "bronze_data_dictionary.parquet").exists()
    summary = ingest.application_summary(stored["loan_applications"]).first()
    assert (summary["row_count"], summary["disbursed_pct"], summary["min_amount"], summary["max_amount"]) == (2, 50.0, 100.0, 300.0)
    again = ingest.ingest_data_dictionary(spark, str(raw / "words.csv"), str(tmp_path / "bronze"))
    assert again.count() == 1  # replaced, not appended
    for job in (ingest.ingest_internal_bank, ingest.ingest_bureau, ingest.ingest_loan_applications):
        assert job.__name__.startswith("ingest_")


def test_json_records(spark, tmp_path):
    record = spark.createDataFrame([(0.9, [[1, 2], [3, 4]])], "test_auc double, confusion_matrix array<array<long>>")
    sinks.write_json(record, str(tmp_path / "metrics"))
    found = sinks.read_json(spark, str(tmp_path / "metrics"), defaults={"test_f1": 0.5}).first()
    assert found["test_auc"] == 0.9 and found["test_f1"] == 0.5 and found["confusion_matrix"] == [[1, 2], [3, 4]]
    absent = sinks.read_json(spark, str(tmp_path / "none"), defaults={"test_auc": 0.1}).first()
    assert absent["test_auc"] == 0.1 and absent["n_test"] is None
    with pytest.raises(AnalysisException):
        sinks.read_json(spark, str(tmp_path / "none"))


def test_catalog_and_exports(spark, book, tmp_path):
    outputs = gold.star_schema(book.silver())
    catalog.register(outputs)
    catalog.register({n: book.operational(n) for n in ("borrowers", "delinquency_summary", "risk_segments")})
    assert set(outputs) | {"borrowers", "risk_segments"} <= set(catalog.table_names(spark))
    paths = catalog.export_tables(spark, outputs, str(tmp_path))
    assert len(paths) == 9
    assert spark.read.parquet(paths[0]).count() == outputs["dim_borrower"].count()
    assert catalog.run_sql(spark, "-- a comment\nSELECT count(*) AS n\nFROM borrowers;").first()["n"] == book.silver().count()
    with pytest.raises(AnalysisException):
        catalog.run_sql(spark, "SELECT * FROM no_such_table")


def test_stored_table_is_replaced(spark, tmp_path):
    for n in (3, 5):
        stored = catalog.replace_table(spark.range(n), "loanloom_numbers", str(tmp_path / "numbers"))
        assert stored.count() == n
    spark.sql("DROP TABLE loanloom_numbers")


def test_sql_folder(spark, book, tmp_path):
    catalog.register({"borrowers": book.operational("borrowers")})
    scripts = tmp_path / "sql"
    scripts.mkdir()
    (scripts / "b_rate.sql").write_text("-- default rate\nSELECT avg(default_risk) AS rate FROM borrowers;\n")
    (scripts / "a_count.sql").write_text("SELECT count(*) AS n FROM borrowers")
    (scripts / "empty.sql").write_text("-- nothing here\n")
    (scripts / "notes.txt").write_text("not sql")
    results = catalog.run_sql_folder(spark, str(scripts), str(tmp_path / "out"))
    assert list(results) == ["a_count", "b_rate"]
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "a_count.csv")).first()["n"] == str(book.silver().count())


def test_report_runner_writes_csv(spark, book, tmp_path):
    results = catalog.run_reports({n: book.operational(n) for n in ("borrowers", "risk_segments")}, str(tmp_path))
    assert list(results) == list(reports.REPORTS)
    stored = spark.read.option("header", True).csv(str(tmp_path / "04_delinquency_funnel.csv"))
    assert stored.count() == 4


def test_export_file_uses_outside_names(spark, book, tmp_path):
    sinks.write_export(export.scored_export(book.scored()), str(tmp_path / "export"))
    back = spark.read.option("header", True).csv(str(tmp_path / "export"))
    assert "risk_band" in back.columns and "pd_band" not in back.columns and back.count() == book.silver().count()
    sinks.write_silver(book.silver(), str(tmp_path / "silver"))
    assert "risk_band" in spark.read.parquet(str(tmp_path / "silver")).columns


def test_models_are_stored_and_found(spark, book, tmp_path):
    matrix = modelling.feature_matrix(book.silver())
    model = modelling.logistic_model(matrix)
    metrics = modelling.metrics_record(modelling.evaluate(modelling.score(matrix, model)), 15)
    path = str(tmp_path / "model")
    sinks.save_model(model, path, modelling.input_features(model), metrics)
    found = sinks.load_model([str(tmp_path / "absent"), path])
    assert isinstance(found, PipelineModel)
    assert modelling.input_features(found) == modelling.input_features(model)
    record = spark.read.schema(schemas.MODEL_METADATA).json(path + "_metadata").first()
    assert record["n_features"] == 15 and record["model_type"] == "LogisticRegressionModel"
    assert json.dumps(record["metrics"]["confusion_matrix"]).count("[") == 3
    with pytest.raises(FileNotFoundError):
        sinks.load_model([str(tmp_path / "absent")])


def test_layers_are_written_once_to_the_named_folder(spark, folder):
    book = LoanBook(spark, folder)
    first, second = book.silver().inputFiles(), LoanBook(spark, folder).silver().inputFiles()
    assert first == second
    assert all(shared_folder(spark) in f for f in first)
    book.refresh()
    assert book.silver().inputFiles() != first


def test_no_folder_on_a_cluster_means_no_local_files(spark, folder, monkeypatch):
    from loanloom import book as module
    monkeypatch.setattr(module, "shared_folder", lambda s: None)
    monkeypatch.setattr(module, "_written", {})
    lazily = LoanBook(spark, folder).silver()
    assert all("/loanloom/" not in f for f in lazily.inputFiles())
    assert lazily.count() == spark.read.parquet(f"{folder}/customer.parquet").count()


def test_settings_follow_the_data():
    from loanloom.session import settings
    assert settings(0, 4)["spark.sql.shuffle.partitions"] == "8"
    assert int(settings(100 * 2**40, 8000)["spark.sql.shuffle.partitions"]) == 100_000
    assert settings(10 * 2**30, 4)["spark.sql.shuffle.partitions"] == "41"


def test_both_batch_jobs(spark, book, tmp_path):
    from loanloom.plans.layers import build_layers, score_and_export
    raw = tmp_path / "raw"
    sinks.write_csv(book.bank(), str(raw / "bank.csv"))
    sinks.write_parquet(book.bureau(), str(raw / "bureau.parquet"))
    sinks.write_csv(spark.createDataFrame([(1, 100.0, 1.0, 10.0, 0.0, 30.0)], schemas.LOAN_APPLICATIONS), str(raw / "loans.csv"))
    sinks.write_csv(spark.createDataFrame([("a", "b")], schemas.DATA_DICTIONARY), str(raw / "words.csv"))
    done = build_layers(spark, {
        "internal_bank": str(raw / "bank.csv"), "cibil_external": str(raw / "bureau.parquet"),
        "loan_applications": str(raw / "loans.csv"), "data_dictionary": str(raw / "words.csv")}, str(tmp_path / "lake"))
    assert done["key_check"].first()["verdict"] == "perfect"
    assert done["checks"].where("not passed").count() == 0
    names = sorted(done["silver"].columns)
    assert names == sorted(book.silver().columns)
    assert sorted(map(str, done["silver"].select(names).collect())) == sorted(map(str, book.silver().select(names).collect()))
    assert len(list((tmp_path / "lake" / "gold").iterdir())) == 9
    assert len(list((tmp_path / "lake" / "reports").iterdir())) == 10

    model = modelling.logistic_model(modelling.feature_matrix(done["silver"]))
    model.write().overwrite().save(str(tmp_path / "model"))
    summary = score_and_export(spark, str(tmp_path / "lake" / "silver" / "silver_master.parquet"),
                               [str(tmp_path / "newer"), str(tmp_path / "model")], str(tmp_path / "scored"))
    assert summary.first()["total_rows"] == book.silver().count()
    assert spark.read.parquet(str(tmp_path / "scored" / "explanations")).count() == book.silver().count()
