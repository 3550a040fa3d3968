"""Writing results: Parquet, CSV, JSON records, trained models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom import schemas
from loanloom.operators.boosting import BoostedTrees
from loanloom.operators.export import named_for_sink

TREES = "trees.json"


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers, written by all tasks."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_silver(silver: DataFrame, path: str) -> None:
    write_parquet(named_for_sink(silver), path)


def read_silver(spark: SparkSession, path: str) -> DataFrame:
    """A stored silver table under the names the operators use."""
    return spark.read.parquet(path).withColumnRenamed("risk_band", "grade_band")


def write_export(export: DataFrame, path: str) -> None:
    write_csv(named_for_sink(export), path)


def write_json(record: DataFrame, path: str) -> None:
    """A one-row record (metrics, metadata)."""
    record.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType = schemas.MODEL_METRICS,
              defaults: dict | None = None) -> DataFrame:
    """A stored record; absent files and fields take the defaults."""
    values = defaults or {}
    try:
        found = spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND" or defaults is None:
            raise
        found = spark.createDataFrame([tuple(values.get(n) for n in schema.fieldNames())], schema)
    return found.fillna({n: v for n, v in values.items() if isinstance(v, (int, float, str))})


def save_model(model: PipelineModel | BoostedTrees, path: str, features: Sequence[str], metrics: DataFrame) -> None:
    """The model, and next to it its features, metrics and type.

    Pipelines are stored as Spark does, trees as one line of JSON.
    """
    if isinstance(model, BoostedTrees):
        line = metrics.sparkSession.createDataFrame([(model.to_json(),)], "value string")
        line.coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/{TREES}")
    else:
        model.write().overwrite().save(path)
    record = metrics.select(
        F.array(*[F.lit(c) for c in features]).alias("feature_names"),
        F.lit(len(features)).cast("long").alias("n_features"),
        F.struct(*metrics.columns).alias("metrics"),
        F.lit(type(model if isinstance(model, BoostedTrees) else model.stages[-1]).__name__).alias("model_type"))
    write_json(record, f"{path.rstrip('/')}_metadata")


def _exists(path: str) -> bool:
    try:
        SparkSession.active().read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def load_model(candidates: Sequence[str]) -> PipelineModel | BoostedTrees:
    """The first candidate that exists."""
    for path in candidates:
        if _exists(f"{path.rstrip('/')}/{TREES}"):
            return BoostedTrees.from_json(SparkSession.active().read.text(f"{path.rstrip('/')}/{TREES}").first()["value"])
        if _exists(f"{path.rstrip('/')}/metadata"):
            return PipelineModel.load(path)
    raise FileNotFoundError(f"no model at any of {list(candidates)}")
