"""Writers: partitioned tables, versioned snapshots and markdown export."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.sources import walletsource


def append_by_day(rows: DataFrame, path: str, ts: str = "ts", day: str = "turn_date") -> None:
    """Append to a table partitioned by day.

    The rebalance hint lets AQE split a day that holds much of the data over
    several files and merge small ones.
    """
    dated = rows.withColumn(day, F.to_date(ts))
    dated.hint("rebalance", day).write.mode("append").partitionBy(day).parquet(path)


def _current(spark: SparkSession, base: str):
    """(version, folder) of the newest complete snapshot, or None."""
    try:
        log = spark.read.schema("version bigint, folder string").parquet(f"{base}/log")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return log.agg(F.max(F.struct("version", "folder")).alias("last")).first()["last"]


def current_folder(spark: SparkSession, base: str) -> str | None:
    """Path of the newest complete snapshot, None before the first."""
    current = _current(spark, base)
    return None if current is None else f"{base}/{current['folder']}"


def new_folder(base: str) -> str:
    """An unused path for the next snapshot."""
    return f"{base}/snapshot-{uuid.uuid4().hex}"


def publish(spark: SparkSession, base: str, folder: str) -> int:
    """List a complete snapshot as the newest one."""
    current = _current(spark, base)
    version = 1 if current is None else current["version"] + 1
    entry = spark.createDataFrame([(version, folder.rpartition("/")[2])], "version bigint, folder string")
    entry.coalesce(1).write.mode("append").parquet(f"{base}/log")
    return version


def read_snapshot(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """Rows of the newest snapshot; an empty table before the first write."""
    folder = current_folder(spark, base)
    return spark.createDataFrame([], schema) if folder is None else spark.read.schema(schema).parquet(folder)


def write_snapshot(rows: DataFrame, base: str) -> int:
    """Write the next snapshot beside the old ones, which stay readable meanwhile.

    A snapshot counts only once its log row is written, so a failed write
    leaves the previous one current.
    """
    folder = new_folder(base)
    rows.write.mode("errorifexists").parquet(folder)
    return publish(rows.sparkSession, base, folder)


def export_markdown(rows: DataFrame, root: str) -> DataFrame:
    """Write each (path, content) row as a file below a mounted folder: all of them, or none if the job fails.

    Returns one (path, ok, error) row per file; a path that leaves the folder is
    refused and stops nothing. For interchange with file-based wallets; bulk
    storage is the day table.
    """
    walletsource.register(rows.sparkSession)
    parts = F.split("path", "/")
    refused = F.col("path").isNull() | (F.col("path") == "") | F.startswith("path", F.lit("/"))
    refused = refused | F.array_contains(parts, "..") | (F.get(parts, F.lit(0)) == walletsource.STAGING)
    rows = rows.select("path", "content", F.coalesce(refused, F.lit(True)).alias("_refused"))
    rows.filter("NOT _refused").select("path", "content").write.format("wallet").mode("append").save(root)
    error = F.when(F.col("_refused"), "path leaves the folder")
    return rows.select("path", (~F.col("_refused")).alias("ok"), error.alias("error"))


def read_text(spark: SparkSession, base: str) -> str:
    """A small text such as the profile, kept as a one-row snapshot; '' before the first write."""
    row = read_snapshot(spark, base, "content string").first()
    return row["content"] if row else ""


def write_text(spark: SparkSession, base: str, content: str) -> None:
    write_snapshot(spark.createDataFrame([(content,)], "content string").coalesce(1), base)
