"""Reading tables for CPU-bound text work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame, key: str) -> DataFrame:
    """At least one task per core, whatever the file layout.

    A Parquet file with one row group is one task however many cores wait.
    Scans that already have a task per core, as any large table does, are
    returned as they are, so big inputs never pay for this shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores, key)
