"""Passages, their vectors and scores, and bodies fetched late."""

from __future__ import annotations

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from turnlake.engine import MemoryEngine
from turnlake.operators import passages
from turnlake.plans import search
from turnlake.sources import bodies, sinks

SCHEMA = "id bigint, text string"


def pieces(text, size, overlap):
    if not text:
        return []
    step = size - overlap
    count = 1 + max(0, math.ceil((len(text) - size) / step))
    return [(i, i * step, text[i * step : i * step + size]) for i in range(count)]


@pytest.mark.parametrize(("size", "overlap"), [(10, 3), (5, 0), (1600, 240)])
def test_cut_covers_every_text(spark, size, overlap):
    texts = [None, "", "a", "x" * size, "y" * (size + 1), "é🙂" * 40, "".join(chr(97 + i % 26) for i in range(4000))]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    found = {}
    for row in passages.cut(docs, "id", F.col("text"), size, overlap).collect():
        found.setdefault(row["id"], []).append((row["passage"], row["start"], row["text"]))
    assert {i: sorted(v) for i, v in found.items()} == {i: pieces(t, size, overlap) for i, t in enumerate(texts) if t}
    for i, own in found.items():
        last = max(own)
        assert last[1] + len(last[2]) == len(texts[i])


def test_failing_passages_cost_nothing_but_themselves(spark):
    docs = spark.createDataFrame([(i, f"text {i} " + ("bad" if i % 7 == 0 else "good")) for i in range(100)], SCHEMA)

    def model(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [[1.0, float(len(t))] for t in texts]

    cut = passages.cut(docs, "id", F.col("text"), 8, 2).repartition(3)
    embedded = passages.embed(cut, "id", model).cache()
    want_bad = {(i, p) for i in range(100) for p, _, t in pieces(f"text {i} " + ("bad" if i % 7 == 0 else "good"), 8, 2) if "bad" in t}
    bad = {(r["id"], r["passage"]) for r in embedded.filter("error IS NOT NULL").collect()}
    assert bad == want_bad and embedded.filter("embedding IS NULL").count() == len(bad)
    counts = passages.counters(embedded, "id").first()
    assert tuple(counts) == (100, embedded.count() - len(bad), len(bad))
    assert passages.best(embedded, "id", F.lit([1.0, 0.0])).count() == 100  # each document keeps a passage
    short = passages.embed(cut, "id", lambda texts: [[1.0]] * (len(texts) - 1 if len(texts) > 1 else 1))
    assert short.filter("error IS NOT NULL").count() == 0  # a wrong number of vectors is a failure too, then single texts work


def test_best_passage_is_the_first_of_equals(spark):
    rows = [(1, 0, 0, [1.0, 0.0]), (1, 1, 5, [0.0, 1.0]), (1, 2, 10, [0.0, 1.0]), (2, 0, 0, [0.0, 0.0]), (3, 0, 0, None)]
    embedded = spark.createDataFrame(rows, "id bigint, passage bigint, start bigint, embedding array<float>")
    found = passages.best(embedded, "id", F.lit([0.0, 1.0])).orderBy("id").collect()
    assert [tuple(r) for r in found] == [(1, 1.0, 1, 5), (2, 0.0, 0, 0)]
    assert passages.nearest(embedded, "id", F.lit([0.0, 1.0]), 1).first()["id"] == 1


def test_rerank_orders_anew_and_keeps_what_fails(spark):
    hits = spark.createDataFrame([(1, 0.9, "aa"), (2, 0.8, "boom"), (3, 0.7, "cccc"), (4, 0.6, None)], "id int, score double, t string")

    def scorer(question, texts):
        if "boom" in texts:
            raise ValueError
        return [len(t) / 10 for t in texts]

    found = {r["id"]: (r["score"], r["reranked"]) for r in passages.rerank(hits, "q", "t", scorer).collect()}
    assert found == {1: (0.2, True), 2: (0.8, False), 3: (0.4, True), 4: (0.6, False)}


def test_bodies_are_stored_once_and_read_by_range(spark, tmp_path):
    store = f"{tmp_path}/bodies"
    texts = [f"body {i % 60}" for i in range(200)]
    rows = spark.createDataFrame([(hashlib.sha256(t.encode()).hexdigest(), t) for t in texts], "hash string, body string")
    bodies.add(rows, store)
    bodies.add(rows.limit(50), store)
    assert bodies.stored(spark, store).count() == 60
    hits = rows.limit(3).select("hash", F.lit(None).cast("string").alias("body")).union(
        spark.createDataFrame([("f" * 64, None), ("e" * 64, "carried"), (None, None)], "hash string, body string")
    )
    found = [r["body"] for r in bodies.attach(hits, store).collect()]
    assert sorted(found) == sorted(["body 0", "body 1", "body 2", "", "carried", ""])
    plan = bodies.fetch(spark, store, [rows.first()["hash"]])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*hash_range", plan) and re.search(r"PushedFilters: \[[^\]]*EqualTo\(hash,", plan)
    assert bodies.attach(hits, f"{tmp_path}/none").filter("body = ''").count() == 5


def test_result_shape(spark, tmp_path):
    store = f"{tmp_path}/bodies"
    digest = hashlib.sha256(b"Body text").hexdigest()
    bodies.add(spark.createDataFrame([(digest, "Body text")], "hash string, body string"), store)
    index = spark.createDataFrame([("turns", "a/b.md", "Title", digest)], "collection string, path string, title string, hash string")
    hits = spark.createDataFrame([("turns", "a/b.md", 0.5, "chunk"), ("turns", "gone.md", 0.4, "x")], "collection string, path string, score double, best_chunk string")
    found = search.results(hits, index.withColumn("modified_at", F.lit("2026-01-01").cast("timestamp")), store).collect()
    assert len(found) == 1
    row = found[0].asDict()
    assert row.pop("modified_at") is not None
    assert row == {
        "file": "turns/a/b.md", "display_path": "a/b.md", "title": "Title", "collection_name": "turns", "context": None,
        "hash": digest, "docid": digest[:6], "score": 0.5, "best_chunk": "chunk", "body": "Body text", "body_length": 9,
    }


def test_engine_embeds_passages_and_tries_failed_ones_again(spark, tmp_path):
    engine = MemoryEngine(spark, f"{tmp_path}/store")
    rows = [(f"t{i}", "s", i, f"question {i} about joins", "long answer. " * (200 if i == 2 else 2)) for i in range(4)]
    turns = spark.createDataFrame(rows, "turn_id string, session_id string, turn_index bigint, user_content string, assistant_content string")
    more = {"tool": F.lit("a"), "model": F.lit("m"), "ts": F.lit("2026-01-01").cast("timestamp"), "fingerprint": F.lit("default")}
    sinks.append_by_day(turns.withColumns(more), f"{engine.root}/turns")

    def picky(texts):
        if any("question 1 " in t for t in texts):
            raise RuntimeError
        return [[float("question 3" in t), 1.0] for t in texts]

    assert engine.embed_passages(picky) == {"docs_processed": 4, "chunks_embedded": 4, "errors": 1}
    assert engine.embed_passages(lambda texts: [[0.0, 1.0] for _ in texts]) == {"docs_processed": 1, "chunks_embedded": 1, "errors": 0}
    assert engine.embed_passages() == {"docs_processed": 0, "chunks_embedded": 0, "errors": 0}
    found = engine.search_passages("joins", [1.0, 0.0], 2)
    assert found.columns == ["turn_id", "score", "best_chunk", "best_chunk_pos"]
    assert found.first()["turn_id"] in ("t0", "t3")
    scored = engine.search_passages("joins", [1.0, 0.0], 2, lambda q, texts: [float("question 2" in t) for t in texts])
    assert scored.first()["turn_id"] == "t2"
