"""Captures out of order, within the lateness allowed, give the sessions of the batch operator."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from turnlake.operators import sessions
from turnlake.streaming import late

SCHEMA = "capture_id string, wallet_id bigint, tool string, n bigint, t bigint, model string, incognito boolean"


def numbered(spark, tmp_path, parts, lateness):
    source = f"{tmp_path}/in"
    for rows in parts:
        rows.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        late.number_sessions(stream, "haiku", lateness).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


@pytest.mark.parametrize(("spread", "lateness"), [(200, "300 seconds"), (15, "40 seconds")])
def test_shuffled_captures_equal_batch(spark, tmp_path, spread, lateness):
    rng = random.Random(5)
    rows = [
        (f"c{i:03d}", rng.randint(0, 2), rng.choice(["x", "y"]), rng.randint(1, 9), 1000 + i - i % 3, rng.choice(["big", "tiny-haiku"]), rng.random() < 0.1)
        for i in range(160)
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("t"))
    arrival = sorted(rows, key=lambda r: (r[4] + rng.randint(0, spread), r[0]))
    parts = [spark.createDataFrame(arrival[i : i + 40], SCHEMA).withColumn("ts", F.timestamp_seconds("t")) for i in range(0, 160, 40)]
    end = spark.createDataFrame([(None, None, None, None, 5000, None, None)], SCHEMA).withColumn("ts", F.timestamp_seconds("t"))
    columns = ["wallet_id", "capture_id", "session_no"]
    got = sorted(map(tuple, numbered(spark, tmp_path, [*parts, end], lateness).select(columns).collect()))
    assert got == sorted(map(tuple, sessions.assign_sessions(df, "haiku").select(columns).collect()))


def test_what_may_still_be_overtaken_waits(spark, tmp_path):
    rows = [(f"c{i}", 1, "x", i + 1, 1000 + 10 * i, "big", False) for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("t"))
    found = numbered(spark, tmp_path, [df], "30 seconds")
    assert sorted(r.capture_id for r in found.collect()) == [f"c{i}" for i in range(6)]
