"""A loan book: the layers derived from one folder of raw tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loanloom.constants import KEY
from loanloom.operators import gold, scoring, silver
from loanloom.sources import borrowers

_written: dict[tuple[str, str, str], tuple[str, StructType]] = {}
_local_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str | None:
    """The folder the cluster names for checkpoints.

    Only a local session without one gets a temporary folder; on a cluster the result is
    None and layers are then not written but recomputed by each query.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        return None
    application = spark.sparkContext.applicationId
    if application not in _local_folder:
        _local_folder[application] = tempfile.mkdtemp(prefix="loanloom-")
    return _local_folder[application]


class LoanBook:
    """Bank file, bureau file, silver table, star schema and scored table of one folder.

    The silver table is the product of the only heavy pipeline (order lines to borrowers).
    It is written once per application to the shared folder and read from there, so every
    query scans a narrow columnar table and survives the loss of any executor.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def records(self) -> DataFrame:
        """Raw borrower columns straight from the raw tables, as one lazy plan."""
        return borrowers.borrower_records(self.spark, self.folder)

    def bank(self) -> DataFrame:
        return borrowers.bank_file(self.raw())

    def bureau(self) -> DataFrame:
        return borrowers.bureau_file(self.raw())

    def raw(self) -> DataFrame:
        """Raw borrower columns, written once; both source files are projections of it."""
        return self._once("raw", self.records)

    def silver(self) -> DataFrame:
        return self._once("silver", lambda: silver.silver_master(self.bank(), self.bureau()))

    def operational(self, name: str) -> DataFrame:
        return silver.OPERATIONAL[name](self.silver())

    def gold(self, name: str) -> DataFrame:
        return gold.OUTPUTS[name](self.silver())

    def scored(self) -> DataFrame:
        """Silver with the rule-based probability of default."""
        return self.silver().withColumn("predicted_pd", scoring.rule_pd())

    def refresh(self) -> None:
        """Forget the written layers, so that the next use reads the raw tables again."""
        application = self.spark.sparkContext.applicationId
        for slot in [s for s in _written if s[:2] == (application, self.folder)]:
            del _written[slot]

    def _once(self, layer: str, build) -> DataFrame:
        spark = self.spark
        slot = (spark.sparkContext.applicationId, self.folder, layer)
        if slot not in _written:
            folder = shared_folder(spark)
            if folder is None:
                return build()
            path = f"{folder.rstrip('/')}/loanloom/{slot[0]}/{layer}-{uuid.uuid4().hex}"
            layer_rows = build()
            layer_rows.write.parquet(path)
            _written[slot] = (path, layer_rows.schema)
        path, schema = _written[slot]
        return spark.read.schema(schema).parquet(path)


class GappyBook(LoanBook):
    """The same book with values missing from the source files, as real files have them.

    Which borrowers lack a value depends on their key alone, so layers and checks agree on it.
    """

    # column: (every so many keys, remainder of those without a value)
    GAPS = {"NETMONTHLYINCOME": (7, 3), "AGE": (11, 5), "EDUCATION": (13, 1), "MARITALSTATUS": (17, 2), "Gold_TL": (19, 4),
            "CC_utilization": (5, 2), "Time_With_Curr_Empr": (23, 6)}

    def raw(self) -> DataFrame:
        return super().raw().withColumns({c: F.when(F.col(KEY) % every != rest, F.col(c))
                                          for c, (every, rest) in self.GAPS.items()})

    def silver(self) -> DataFrame:
        return self._once("silver-gappy", lambda: silver.silver_master(self.bank(), self.bureau()))
