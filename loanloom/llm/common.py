"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# words of every contract: runs of anything but space, tab, line feed, vertical tab, form feed, carriage return
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session without that setting (a test, a notebook) gets a folder of its own;
    a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loanloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, wherever they run."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="loanloom-code-")) / "loanloom.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for file in sorted(package.rglob("*.py")):
                archive.write(file, str(file.relative_to(package.parent)))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(application)


# rows that a task's Python turns into objects, and sends back, at a time
BATCH_ROWS = 512


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``BATCH_ROWS``.

    Spark's own hold 10,000 rows however long their texts are, and a worker that goes on to the next
    task keeps the memory that its largest batch and answer took.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


_scratch: list[str] = []


def kept(df: DataFrame, name: str, *, by: str | None = None, lasting: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage: a lost executor costs nothing but its tasks, and expensive columns are
    computed once however often the table is read. ``sweep`` deletes it unless it is ``lasting``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loanloom-llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    if not lasting:
        _scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables ``kept`` has written that ``sweep`` would delete."""
    return len(_scratch)


def sweep(spark: SparkSession, but: int = 0) -> None:
    """Delete all tables, ``but`` for the first ones, that ``kept`` wrote and nobody reads any more: results made so far are stored."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while len(_scratch) > but:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(conf).delete(path, True)
    release(spark)


def forget(df: DataFrame) -> None:
    """Delete a table written by ``kept`` (not partitioned) that no later step reads."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps whose results are written.

    It does so for what the driver's memory no longer holds, and a long job of many steps can't
    wait until the driver happens to collect its garbage.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(name: str, columns: Sequence[str]) -> str:
    """A column name that ``columns`` does not have yet, upper and lower case alike."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Written copy of ``docs`` with a number for every row, and the name of that column.

    The number tells repeated rows apart. It is fixed once written, so a task that runs again
    sees the same one.
    """
    row = fresh("_row", docs.columns)
    return kept(docs.withColumn(row, F.monotonically_increasing_id()), name), row


def word_count(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
