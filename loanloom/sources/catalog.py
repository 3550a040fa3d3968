"""Tables and views by name, and SQL over them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.operators.reports import REPORTS
from loanloom.sources.sinks import write_csv, write_parquet


def register(tables: Mapping[str, DataFrame]) -> None:
    """Make tables available to SQL under their names, replacing earlier ones."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def replace_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Create or replace a stored table from a query."""
    writer = df.write.mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def table_names(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def export_tables(spark: SparkSession, names: Iterable[str], target: str) -> list[str]:
    """Every named table or view to its own Parquet folder."""
    paths = []
    for name in names:
        path = f"{target.rstrip('/')}/{name}.parquet"
        write_parquet(spark.table(name), path)
        paths.append(path)
    return paths


def without_comment_lines(text: str) -> str:
    lines = (line for line in text.splitlines() if not line.strip().startswith("--"))
    return "\n".join(lines).strip().rstrip(";")


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    """One statement against the registered tables; errors reach the caller."""
    return spark.sql(without_comment_lines(text))


def run_sql_folder(spark: SparkSession, folder: str, target: str) -> dict[str, DataFrame]:
    """Run every ``*.sql`` file of a folder and store each result as CSV.

    A file that holds nothing but comments is skipped.
    """
    files = (spark.read.option("wholetext", True).option("pathGlobFilter", "*.sql").text(folder)
             .select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.sql$", 1).alias("name"),
                     F.col("value").alias("text")))
    results = {}
    for row in sorted(files.collect(), key=lambda r: r["name"]):
        if without_comment_lines(row["text"]):
            results[row["name"]] = run_sql(spark, row["text"])
            write_csv(results[row["name"]], f"{target.rstrip('/')}/{row['name']}.csv")
    return results


def run_reports(tables: Mapping[str, DataFrame], target: str | None = None) -> dict[str, DataFrame]:
    """The ten reports, rounded for display; stored as CSV if a folder is given."""
    results = {name: report.run(dict(tables)) for name, report in REPORTS.items()}
    if target:
        for name, df in results.items():
            write_csv(df, f"{target.rstrip('/')}/{name}.csv")
    return results
