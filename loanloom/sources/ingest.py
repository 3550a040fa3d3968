"""Bronze jobs: read a raw file, tag it, store it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom import schemas
from loanloom.operators.profile import source_summary, value_counts
from loanloom.operators.quality import key_reconciliation
from loanloom.sources.sinks import write_parquet
from loanloom.sources.tables import read_csv

# ---- fixed values: dataset = source tag --------------------------------------------------
SOURCE_TAGS = {
    "internal_bank": "kaggle_internal_bank",
    "cibil_external": "kaggle_cibil_external",
    "loan_applications": "kaggle_loan_applications",
    "data_dictionary": "kaggle_data_dictionary",
}
SCHEMAS: dict[str, T.StructType] = {
    "internal_bank": schemas.BANK,
    "cibil_external": schemas.BUREAU,
    "loan_applications": schemas.LOAN_APPLICATIONS,
    "data_dictionary": schemas.DATA_DICTIONARY,
}
# what each job reports about its source: key column and measured columns
SUMMARIES = {
    "internal_bank": ("PROSPECTID", ()),
    "cibil_external": ("PROSPECTID", ("Credit_Score", "NETMONTHLYINCOME")),
}


def with_metadata(df: DataFrame, source: str) -> DataFrame:
    """Source tag and UTC time of ingestion, one and the same for the whole job."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return df.withColumns({"_source": F.lit(source),
                           "_ingested_at": F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")})


def read_raw(spark: SparkSession, dataset: str, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV by its ending, Parquet otherwise."""
    if path.endswith(".csv"):
        return read_csv(spark, path, schema or SCHEMAS[dataset])
    return spark.read.parquet(path)


def bronze_path(target: str, dataset: str) -> str:
    return f"{target.rstrip('/')}/bronze_{dataset}.parquet"


def ingest(spark: SparkSession, dataset: str, path: str, target: str,
           schema: T.StructType | None = None) -> DataFrame:
    raw = read_raw(spark, dataset, path, schema)
    write_parquet(with_metadata(raw, SOURCE_TAGS[dataset]), bronze_path(target, dataset))
    return spark.read.parquet(bronze_path(target, dataset))


def _job(dataset: str) -> Callable[..., DataFrame]:
    def run(spark: SparkSession, path: str, target: str, schema: T.StructType | None = None) -> DataFrame:
        return ingest(spark, dataset, path, target, schema)
    run.__name__ = f"ingest_{dataset}"
    return run


ingest_internal_bank = _job("internal_bank")
ingest_bureau = _job("cibil_external")
ingest_loan_applications = _job("loan_applications")
ingest_data_dictionary = _job("data_dictionary")


def summarise(dataset: str, df: DataFrame) -> DataFrame:
    key, measures = SUMMARIES[dataset]
    return source_summary(df, key, measures)


def grade_distribution(bureau: DataFrame) -> DataFrame:
    return value_counts(bureau, "Approved_Flag")


def application_summary(applications: DataFrame) -> DataFrame:
    return applications.agg(
        F.count("*").alias("row_count"), (F.avg("Disbursed") * 100).alias("disbursed_pct"),
        F.min("Loan_Amount_Applied").alias("min_amount"), F.max("Loan_Amount_Applied").alias("max_amount"))


def ingest_all(spark: SparkSession, paths: dict[str, str], target: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """All four jobs and the key reconciliation of bank against bureau."""
    stored = {name: ingest(spark, name, path, target) for name, path in paths.items()}
    return stored, key_reconciliation(stored["internal_bank"], stored["cibil_external"])
