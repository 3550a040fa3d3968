"""Session settings that fit the size of the input."""

from __future__ import annotations

# a shuffle partition of about this size sorts in memory on ordinary executors
TARGET_PARTITION_BYTES = 256 * 1024 * 1024
MIN_PARTITIONS, MAX_PARTITIONS = 8, 100_000


def settings(shuffle_bytes: int, cores: int) -> dict[str, str]:
    """Spark settings for a job that moves about ``shuffle_bytes`` in its widest shuffle.

    Partitions are planned from the data and merged at run time where they turn out
    small; partitions a hot key makes too large are split at run time.
    """
    wanted = max(shuffle_bytes // TARGET_PARTITION_BYTES + 1, 2 * cores, MIN_PARTITIONS)
    return {
        "spark.sql.shuffle.partitions": str(min(wanted, MAX_PARTITIONS)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TARGET_PARTITION_BYTES),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * TARGET_PARTITION_BYTES),
        "spark.sql.files.maxPartitionBytes": str(TARGET_PARTITION_BYTES),
        "spark.sql.session.timeZone": "UTC",
    }
