"""Session settings and the shared working folder."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def build_session(app_name: str = "turnlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for.

    AQE coalesces small shuffle partitions and splits skewed join partitions, so
    ``spark.sql.shuffle.partitions`` should be set for the largest stage (about
    128 MB of shuffle data per partition) rather than for the smallest.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings results depend on (all dates are UTC) and bound what Python holds at once."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    bounded_batches(spark)
    return spark


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches of texts hold at most BATCH_ROWS rows and BATCH_BYTES, whichever comes first.

    The defaults count rows alone and suit numbers; ten thousand long texts in
    one batch would be held several times over by a task and its Python worker.
    Smaller settings of the session stay.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master, whose executors share the driver's disk, gets one
    created here; elsewhere the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    set_by_user = spark.sparkContext.getCheckpointDir()
    if set_by_user:
        return set_by_user
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    fallback = tempfile.mkdtemp(prefix="turnlake-")
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return posixpath.join(shared_dir(spark), f"turnlake-{label}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder so later plans see fixed rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: fixed rows, read by column."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
