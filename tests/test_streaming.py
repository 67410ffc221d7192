"""Streams give what the batch operators give."""

from __future__ import annotations

import os
import random

from pyspark.sql import functions as F

from turnlake.operators import sessions, turns
from turnlake.streaming import ingest
from turnlake.streaming.sessions import number_sessions


def test_sessions_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [
        (f"c{i:03d}", rng.randint(0, 2), rng.choice(["x", "y"]), rng.randint(1, 9), i, rng.choice(["big", "tiny-haiku"]), rng.random() < 0.1)
        for i in range(120)
    ]
    schema = "capture_id string, wallet_id bigint, tool string, n bigint, t bigint, model string, incognito boolean"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("t"))
    source = f"{tmp_path}/in"
    for part in range(4):  # files arrive in time order
        df.filter((F.col("t") >= part * 30) & (F.col("t") < part * 30 + 30)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        number_sessions(stream, "haiku").writeStream.format("parquet").option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    columns = ["wallet_id", "capture_id", "session_no"]
    got = spark.read.parquet(f"{tmp_path}/out").select(columns)
    expected = sessions.assign_sessions(df, "haiku").select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_resent_turns_are_stored_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "LATEST_EVERY", 2)

    def send(rows):
        listed = [(c, 0, 0, [{"role": r, "content": t} for r, t in messages], hidden) for c, hidden, messages in rows]
        spark.createDataFrame(listed, ingest.CAPTURE_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = ingest.capture_stream(spark, source, 1)
        ingest.start_ingest(stream, out, checkpoint, availableNow=True).awaitTermination()

    source, out, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"
    first, second = (1, None, [("user", "q"), ("assistant", "a")]), [("user", "x"), ("assistant", "y")]
    send([first, (2, False, second), (3, True, second)])
    send([first, (2, False, [("user", "x"), ("assistant", "new")])])
    for _ in range(3):
        send([first, (2, False, [("user", "x"), ("assistant", "new")])])
    log = spark.read.parquet(f"{out}/documents").collect()
    assert sorted((r.batch, r.path) for r in log) == [(0, "conv-1-0.md"), (0, "conv-2-0.md"), (1, "conv-2-0.md")]
    assert spark.read.parquet(f"{out}/turns").count() == 3
    assert spark.read.parquet(f"{out}/contents").count() == 3
    current = {r.conv_id: r.assistant_content for r in ingest.current_turns(spark, out).collect()}
    assert current == {1: "a", 2: "new"}


def test_of_two_forms_in_one_batch_the_later_capture_counts(spark, tmp_path):
    source, out = tmp_path / "in", f"{tmp_path}/out"
    for time, answer in ((1_700_000_000, "zebra"), (1_700_000_500, "apple")):
        rows = [(7, 0, 0, [{"role": "user", "content": "q"}, {"role": "assistant", "content": answer}], False)]
        before = set(source.glob("*.parquet"))
        spark.createDataFrame(rows, ingest.CAPTURE_SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        for file in set(source.glob("*.parquet")) - before:
            os.utime(file, (time, time))
    stream = ingest.capture_stream(spark, str(source))
    ingest.start_ingest(stream, out, f"{tmp_path}/cp", availableNow=True).awaitTermination()
    assert [r.assistant_content for r in ingest.current_turns(spark, out).collect()] == ["apple"]


def test_stream_turns_equal_batch(spark):
    from turnlake.verify.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    streamed = QUERIES["stream_ingest_turns"](spark, sf)
    batch = turns.turn_pairs(spark.read.parquet(f"{sf}/conversations.parquet"))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
