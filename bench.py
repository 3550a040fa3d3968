"""Time the queries: Parquet in, ``noop`` sink out, one warm-up, median of the runs.

``silver_build`` is the whole pipeline from the raw tables; the other queries read the
silver table it leaves behind, as they would in production. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from loanloom import LoanBook
from loanloom.plans.oracle import ORACLE
from loanloom.plans.queries import QUERIES

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
# models are timed once, without a warm-up
MODELS = ("gbt_metrics", "attributions", "borrower_clusters")


def session() -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("loanloom-bench")
             .config("spark.sql.shuffle.partitions", CPUS)
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "7g"))
             .config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    spark = session()
    names = sys.argv[1:] or [*ORACLE, *MODELS]
    seconds = {}
    if not sys.argv[1:]:
        sink(LoanBook(spark, FOLDER).records())  # warms the JVM up, writes nothing
        seconds["silver_build"] = timed(lambda: LoanBook(spark, FOLDER).silver())
    for name in names:
        runs = 1 if name in MODELS else RUNS
        if runs > 1:
            sink(QUERIES[name](spark, FOLDER))
        seconds[name] = statistics.median(timed(lambda: sink(QUERIES[name](spark, FOLDER))) for _ in range(runs))
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": {k: round(v, 3) for k, v in seconds.items()},
                      "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
