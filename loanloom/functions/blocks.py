"""Rows as numeric blocks, for learners that pass over the same rows hundreds of times.

A block is a matrix of at most ``BLOCK_ROWS`` rows. Blocks stay where their partition is; a pass maps
every block to a small array of sums, adds up those of a partition and then, in one task, those of all
partitions. So the driver is sent one array a pass, whose size follows from the model, not from the rows.
"""

from __future__ import annotations

import math
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 16
# a partition of the first size is worth a core, one of the second is as large as it may be
CORE_BYTES = 1 << 22
PARTITION_BYTES = 1 << 26
# bits of a number that one pass over the blocks fixes
DIGIT, WIDTH = 8, 64

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="loanloom-code-")) / "loanloom.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for file in sorted(package.rglob("*.py")):
                archive.write(file, str(file.relative_to(package.parent)))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(application)


def matrix_blocks(df: DataFrame, names: Sequence[str], rows: int) -> RDD:
    """The named columns as matrices of doubles, a row per row; NULL becomes NaN.

    ``rows``, the number of rows, sets how many partitions are worth their tasks: one for each core,
    fewer of a small table, more where they would be too large.
    """
    width = len(names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                matrix = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns]).astype(np.float64)
                yield pa.RecordBatch.from_pydict({"block": pa.array([matrix.tobytes()], pa.binary())})

    ship(df.sparkSession)
    size, cores = rows * width * 8, df.sparkSession.sparkContext.defaultParallelism
    partitions = max(1, math.ceil(size / PARTITION_BYTES), min(cores, math.ceil(size / CORE_BYTES)))
    numbers = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    numbers = numbers.repartition(partitions) if partitions > 1 else numbers.coalesce(1)
    return numbers.mapInArrow(pack, "block binary").rdd.map(lambda r: np.frombuffer(r["block"]).reshape(-1, width))


def summed(blocks: RDD, of: Callable[[object], np.ndarray]) -> np.ndarray:
    """The sum of an array over all blocks, put together before it is sent to the driver."""
    def added(arrays: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        first = next(arrays, None)
        if first is not None:
            yield reduce(np.add, arrays, first)

    parts = blocks.map(of).mapPartitions(added)
    if blocks.getNumPartitions() > 1:
        parts = parts.repartition(1).mapPartitions(added)
    return parts.collect()[0]


def kept(blocks: RDD) -> RDD:
    return blocks.persist(StorageLevel.MEMORY_AND_DISK)


def _ordered(column: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles, without NaN; zeros are equal."""
    bits = (column[~np.isnan(column)] + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits, bits ^ np.int64(-2 ** 63)).view(np.uint64)


def _double(number: int) -> float:
    bits = number ^ 1 << WIDTH - 1 if number >> WIDTH - 1 else ~number & (1 << WIDTH) - 1
    return float(np.array([bits], dtype=np.uint64).view(np.float64)[0])


def share_ends(matrices: RDD, width: int, shares: Sequence[float]) -> list[list[float]]:
    """By column the distinct values at rank ``ceil(share * n)``, counted from 1; exact. NaN does not count.

    A pass counts the next ``DIGIT`` bits of the numbers that share their leading bits with a wanted one,
    for all columns and shares; no value leaves its block.
    """
    blocks, size = kept(matrices.map(lambda m: [_ordered(c) for c in m.T])), 1 << DIGIT
    # leading bits and, among the numbers that have them, the rank
    wanted: list[list[tuple[int, int]]] = [[] for _ in range(width)]
    try:
        for shift in range(WIDTH - DIGIT, -1, -DIGIT):
            starts = [np.array(sorted({start for start, _ in w}) or [0], dtype=np.uint64) for w in wanted]
            most = max(len(s) for s in starts)

            def counts(block: list[np.ndarray], starts=starts, most=most, shift=shift) -> np.ndarray:
                out = np.zeros((width, most * size), dtype=np.int64)
                for f, (numbers, start) in enumerate(zip(block, starts)):
                    digits = numbers >> np.uint64(shift)
                    high, low = digits >> np.uint64(DIGIT), (digits & np.uint64(size - 1)).astype(np.int64)
                    at = np.minimum(np.searchsorted(start, high), len(start) - 1)
                    hit = start[at] == high
                    out[f] = np.bincount(at[hit] * size + low[hit], minlength=most * size)
                return out

            found = summed(blocks, counts).reshape(width, most, size)
            for f in range(width):
                if shift == WIDTH - DIGIT:
                    n = int(found[f].sum())
                    wanted[f] = [(0, max(1, math.ceil(s * n))) for s in shares] if n else []
                place, following = {int(s): i for i, s in enumerate(starts[f])}, set()
                for start, rank in wanted[f]:
                    upto = np.cumsum(found[f, place[start]])
                    digit = int(np.searchsorted(upto, rank))
                    following.add((start << DIGIT | digit, rank - (int(upto[digit - 1]) if digit else 0)))
                wanted[f] = sorted(following)
    finally:
        blocks.unpersist()
    return [sorted({_double(number) for number, _ in w}) for w in wanted]
