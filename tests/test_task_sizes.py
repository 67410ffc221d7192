"""Tasks and Arrow batches over texts stay of one size, however large the table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from turnlake.operators import bm25, index, slices
from turnlake.session import fresh_dir, prepare


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(slices, "TASK_BYTES", 200)


def texts(spark):
    return spark.range(400).select(F.col("id").alias("k"), F.concat(F.lit("one two "), F.col("id"), F.lit(" one")).alias("t"))


def test_posting_tasks_follow_the_text(spark, small):
    docs = texts(spark)
    found = bm25.postings(docs, F.col("t"), "k")
    assert found.rdd.getNumPartitions() >= slices.text_bytes(docs, F.col("t")) // 200
    assert sorted(map(tuple, found.filter("k = 7").collect())) == [(7, "7", 1), (7, "one", 2), (7, "two", 1)]


def test_index_tasks_follow_the_text(spark, small):
    docs, base = texts(spark), fresh_dir(spark, "sizes")
    index.add(docs, "k", F.col("t"), base)
    folder = index.current(spark, base).folder
    files = spark.read.parquet(f"{folder}/postings").select(F.regexp_extract(F.input_file_name(), r"part-(\d+)-", 1)).distinct()
    assert files.count() > 8  # more than the session's shuffle partitions


def test_usual_tasks_for_small_texts(spark):
    assert slices.tasks_for(0, spark) == 1
    assert slices.tasks_for(3 << 20, spark) == 3
    assert slices.tasks_for(100 << 20, spark) == 8
    assert slices.tasks_for(1 << 30, spark) == 64


def test_arrow_batches_are_bounded(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        rows = prepare(spark).range(0, 5000, 1, 1)
        sizes = rows.mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), "id bigint").count()
        assert sizes == 5
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
