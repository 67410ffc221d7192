"""Structured Streaming: captures in, turn, index and content tables out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnlake.operators import reconcile, turns

CAPTURE_SCHEMA = (
    "conv_id bigint, part bigint, first_index bigint, "
    "messages array<struct<role:string,content:string>>, incognito boolean"
)
TURN_COLUMNS = ("conv_id", "turn_index", "user_content", "assistant_content")
TURN_SCHEMA = "conv_id bigint, turn_index bigint, user_content string, assistant_content string, batch bigint"
INDEX_SCHEMA = "collection string, path string, title string, hash string, batch bigint"
CONTENT_SCHEMA = "hash string, body string, batch bigint"
CAPTURED_AT = "captured_at"
LATEST_EVERY = 16  # batches between two snapshots of the latest hashes


def capture_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New capture files, with the time of their file; ``files_per_trigger`` bounds a micro-batch."""
    files = spark.readStream.schema(CAPTURE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return files.withColumn(CAPTURED_AT, F.col("_metadata.file_modification_time"))


def turns_of_captures(captures: DataFrame) -> DataFrame:
    """Turn pairs of each captured message list, none of incognito ones; row-local, so no state and no shuffle."""
    seen = captures.filter(~F.coalesce("incognito", F.lit(False))) if "incognito" in captures.columns else captures
    timed = [c for c in (CAPTURED_AT,) if c in captures.columns]
    pairs = seen.select("conv_id", "first_index", *timed, F.inline(turns.pairs_in_array(F.col("messages"))))
    return pairs.withColumn("turn_index", F.col("first_index") + F.col("turn_index")).select(*TURN_COLUMNS, *timed)


def turn_body() -> Column:
    return F.concat(
        F.lit("## User\n"), F.col("user_content"), F.lit("\n\n## Assistant\n"), F.col("assistant_content"), F.lit("\n")
    )


def turn_path() -> Column:
    return F.concat(F.lit("conv_"), F.col("conv_id"), F.lit("-"), F.col("turn_index"), F.lit(".md"))


def index_rows(pairs: DataFrame) -> DataFrame:
    return reconcile.described(pairs, "turns", turn_path(), turn_body())


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _latest(log: DataFrame) -> DataFrame:
    """Newest row of each path; combined on the map side."""
    newest = F.max_by(F.struct("title", "hash"), "batch").alias("_latest")
    return log.groupBy(*reconcile.KEY).agg(newest, F.max("batch").alias("batch")).select(
        *reconcile.KEY, "_latest.*", "batch"
    )


def known_index(spark: SparkSession, out: str, batch_id: int) -> DataFrame:
    """Latest hash of every path before a batch: the last snapshot and the few batches after it."""
    snapshot = (batch_id - 1) // LATEST_EVERY * LATEST_EVERY
    log = _read(spark, f"{out}/documents", INDEX_SCHEMA).filter(
        (F.col("batch") >= snapshot) & (F.col("batch") < batch_id)
    )
    older = _read(spark, f"{out}/latest/at={snapshot}", INDEX_SCHEMA) if snapshot > 0 else None
    return _latest(log if older is None else log.unionByName(older))


def current_turns(spark: SparkSession, out: str) -> DataFrame:
    """Each turn as captured last."""
    rows = _read(spark, f"{out}/turns", TURN_SCHEMA)
    newest = F.max_by(F.struct("user_content", "assistant_content"), "batch").alias("_newest")
    return rows.groupBy("conv_id", "turn_index").agg(newest).select("conv_id", "turn_index", "_newest.*")


def start_ingest(captures: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write new and changed turns, their index rows and contents not stored yet.

    Clients resend the whole history with every request; a turn that is stored
    as it is adds nothing. Of several forms of a turn in one micro-batch the one
    captured last counts (``captured_at``, where the stream has it), of equal
    times the greatest by text, so that a replay agrees. Each micro-batch writes
    to folders named after its id with overwrite: replayed after a failure, it
    replaces its own output and nothing else. Nothing of incognito captures is
    written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id > 0 and batch_id % LATEST_EVERY == 0:
            known_index(spark, out, batch_id).write.mode("overwrite").parquet(f"{out}/latest/at={batch_id}")
        found = turns_of_captures(batch)
        form = [c for c in (CAPTURED_AT,) if c in found.columns] + ["user_content", "assistant_content"]
        pairs = (
            found.groupBy("conv_id", "turn_index")
            .agg(F.max(F.struct(*form)).alias("_form"))
            .select("conv_id", "turn_index", "_form.user_content", "_form.assistant_content")
        )
        described = pairs.select(*TURN_COLUMNS, F.struct(*_described()).alias("_row"))
        known = known_index(spark, out, batch_id).select("path", F.col("hash").alias("_known"))
        joined = described.join(known, F.col("_row.path") == known["path"], "left").drop(known["path"])
        changed = joined.filter(F.col("_known").isNull() | (F.col("_known") != F.col("_row.hash"))).drop("_known")
        # Turns are written last: they carry all the rest, which is derived from what was written.
        staged = f"{out}/changed/batch={batch_id}"
        changed.write.mode("overwrite").parquet(staged)
        rows = spark.read.schema(changed.schema).parquet(staged)
        documents = rows.select(F.lit("turns").alias("collection"), "_row.path", "_row.title", "_row.hash", turn_body().alias("content"))
        stored = _read(spark, f"{out}/contents", CONTENT_SCHEMA).filter(F.col("batch") < batch_id)
        reconcile.new_contents(documents, stored).write.mode("overwrite").parquet(f"{out}/contents/batch={batch_id}")
        rows.select(*TURN_COLUMNS).write.mode("overwrite").parquet(f"{out}/turns/batch={batch_id}")
        documents.select("collection", "path", "title", "hash").write.mode("overwrite").parquet(
            f"{out}/documents/batch={batch_id}"
        )

    options = trigger or {"processingTime": "5 minutes"}
    return (
        captures.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**options).start()
    )


def _described() -> list[Column]:
    return reconcile.description(turn_path(), turn_body())
