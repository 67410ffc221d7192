"""The wallet format: all files of a job or none, folders as partitions, filters that name folders."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from turnlake.sources import sinks, wallet, walletsource

SCHEMA = "path string, content string"


def files(root):
    """What readers see; tasks of a failed job may still be staging when it ends."""
    found = (os.path.relpath(os.path.join(d, n), root) for d, _, names in os.walk(root) for n in names)
    return sorted(f for f in found if not f.startswith(walletsource.STAGING))


def test_round_trip_with_metadata(spark, tmp_path):
    walletsource.register(spark)
    rows = [(f"turns/2026-01-0{1 + i % 3}/t{i}.md", f"é text {i}\r\n" * i) for i in range(20)] + [("memories/m.md", ""), ("memories/n.md", None)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.format("wallet").mode("append").save(str(tmp_path))
    assert files(tmp_path) == sorted(p for p, _ in rows)
    back = spark.read.format("wallet").option("collections", "turns,memories,none").load(str(tmp_path))
    found = {f"{r.collection}/{r.path}": r for r in back.collect()}
    assert {p: r.content for p, r in found.items()} == {p: c or "" for p, c in rows}
    one = found["turns/2026-01-02/t4.md"]
    assert (one.folder, one.file_name, one.bytes) == ("2026-01-02", "t4.md", len(("é text 4\r\n" * 4).encode()))
    assert found["memories/m.md"].folder is None
    by_folder = {r.folder: (r.files, r.bytes) for r in wallet.folders(spark, str(tmp_path), "turns").collect()}
    assert by_folder["2026-01-01"][0] == 7 and sum(b for _, b in by_folder.values()) == sum(len((c or "").encode()) for p, c in rows)
    assert back.rdd.getNumPartitions() == 4  # three days and the loose memories


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    walletsource.register(spark)
    root = f"{tmp_path}/w"
    good = spark.createDataFrame([(f"turns/{i}.md", "x") for i in range(50)], SCHEMA).repartition(5)
    bad = good.withColumn("content", F.when(F.col("path") == "turns/33.md", F.raise_error(F.lit("boom"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="boom"):
        bad.write.format("wallet").mode("append").save(root)
    with pytest.raises(Exception, match="leaves the folder"):
        good.union(spark.createDataFrame([("turns/../../x.md", "y")], SCHEMA)).write.format("wallet").mode("append").save(root)
    assert not os.path.isdir(root) or files(root) == []
    good.write.format("wallet").mode("append").save(root)
    assert len(files(root)) == 50
    changed = good.withColumn("content", F.lit("new"))
    changed.write.format("wallet").mode("append").save(root)  # a later job replaces files of the same path
    assert {r.content for r in spark.read.format("wallet").option("collections", "turns").load(root).collect()} == {"new"}


def test_days_asked_for_are_listed_alone(spark, tmp_path):
    walletsource.register(spark)
    rows = [(f"turns/2026-01-{d:02d}/x.md", str(d)) for d in range(1, 20)] + [("turns/loose.md", "-")]
    sinks.export_markdown(spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    day = wallet.read_day(spark, str(tmp_path), "turns", "2026-01-07")
    assert [r.content for r in day.collect()] == ["7"]
    assert day.rdd.getNumPartitions() == 1
    some = spark.read.format("wallet").option("collections", "turns").load(str(tmp_path))
    assert some.filter(F.col("folder").isin("2026-01-07", "2026-01-08", "x")).count() == 2
    assert some.filter("folder IS NULL").count() == 1 and some.count() == 20


def test_what_cannot_be_written_or_read(spark, tmp_path):
    walletsource.register(spark)
    with pytest.raises(Exception, match="missing"):
        spark.range(1).write.format("wallet").mode("append").save(str(tmp_path))
    empty = spark.read.format("wallet").option("collections", "turns").load(f"{tmp_path}/none")
    assert empty.count() == 0 and "content" in empty.columns
    sinks.export_markdown(spark.createDataFrame([("turns/a.md", "x"), ("turns/b.txt", "y")], SCHEMA), str(tmp_path))
    assert wallet.listed(spark, str(tmp_path), ["turns"]).count() == 1
    assert wallet.listed(spark, str(tmp_path), ["turns"], "").count() == 2
