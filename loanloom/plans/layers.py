"""The two batch jobs: raw files to published layers, and published silver to scored export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.constants import KEY
from loanloom.operators import explain, export, gold, modelling, quality, silver
from loanloom.sources import catalog, ingest, sinks


def build_layers(spark: SparkSession, sources: Mapping[str, str], target: str) -> dict[str, DataFrame]:
    """Bronze, silver, gold and the ten reports, each stored under ``target``.

    ``sources`` maps the four dataset names to raw files. Checks are returned, not
    enforced: data is published even when one of them fails.
    """
    root = target.rstrip("/")
    stored, keys = ingest.ingest_all(spark, dict(sources), f"{root}/bronze")
    master = silver.silver_master(stored["internal_bank"], stored["cibil_external"])
    sinks.write_silver(master, f"{root}/silver/silver_master.parquet")
    published = sinks.read_silver(spark, f"{root}/silver/silver_master.parquet")
    sinks.write_parquet(silver.drop_metadata(stored["loan_applications"]),
                        f"{root}/silver/silver_loan_applications.parquet")
    outputs = gold.star_schema(published)
    catalog.register(outputs)
    catalog.export_tables(spark, outputs, f"{root}/gold")
    tables = silver.operational_tables(published)
    catalog.register(tables)
    catalog.run_reports(tables, f"{root}/reports")
    return {"silver": published, "key_check": keys, "checks": quality.quality_checks(published)}


def score_and_export(spark: SparkSession, silver_path: str, models: Sequence[str], target: str) -> DataFrame:
    """Score the silver table with the first model found; store the export and the explanations."""
    root = target.rstrip("/")
    model = sinks.load_model(models)
    scored = modelling.score(sinks.read_silver(spark, silver_path), model)
    sinks.write_parquet(scored, f"{root}/scored")
    scored = spark.read.parquet(f"{root}/scored")
    frame = export.reorder_columns(export.business_columns(scored), modelling.input_features(model))
    sinks.write_export(frame, f"{root}/export.csv")
    told = explain.batch_explain(scored.withColumn("borrower_id", F.col(KEY)))
    sinks.write_parquet(told, f"{root}/explanations")
    return export.export_summary(scored.transform(export.decision_flags).transform(export.loss_columns))
