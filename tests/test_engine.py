"""The whole loop: capture, search, inject, extract, profile, reconcile."""

from __future__ import annotations

import gzip
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from turnlake.config import Config, InjectionConfig, ToolConfig
from turnlake.engine import REQUEST_COLUMNS, MemoryEngine
from turnlake.operators import bm25, documents, index, vectors
from turnlake.sources import sinks, wallet

CONFIG = Config(tools=(ToolConfig("editor", "openai", "k", ""),), injection=InjectionConfig(min_relevance_score=0.05))
AUTH = {"authorization": "Bearer k"}


def request(i, messages, answer, day="2026-03-20", system="You build pipelines.", model="big"):
    listed = ([{"role": "system", "content": system}] if system else []) + [
        {"role": "user" if n % 2 == 0 else "assistant", "content": m} for n, m in enumerate(messages)
    ]
    body = json.dumps({"model": model, "messages": listed})
    response = json.dumps({"choices": [{"message": {"content": answer}}]})
    return (f"r{i}", "/v1/chat/completions", AUTH, body, response, f"{day} 10:{i:02d}:00")


def frame(spark, rows):
    raw = spark.createDataFrame(rows, REQUEST_COLUMNS.replace("ts timestamp", "ts string"))
    return raw.withColumn("ts", F.to_timestamp("ts"))


def now():
    return F.to_timestamp(F.lit("2026-04-01"))


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    built = MemoryEngine(spark, str(tmp_path_factory.mktemp("store")), CONFIG)
    questions = ["How do I salt a skewed join key safely?", "And which window function numbers rows?", "What is a watermark in streaming?"]
    answers = ["Add a random salt to the hot key.", "row_number numbers rows.", "A watermark bounds late data. token = abc123"]
    rows = []
    for i in range(3):
        history = [m for pair in zip(questions[:i], answers[:i]) for m in pair] + [questions[i]]
        rows.append(request(i, history, answers[i]))
    rows.append(request(3, ["Short?"], "Yes.", day="2026-03-21", system=None, model="tiny-haiku"))
    rows.append(("bad", "/v1/chat/completions", AUTH, "{}", "", "2026-03-20 11:00:00"))
    rows.append(("foreign", "/v1/chat/completions", {"authorization": "Bearer other"}, rows[0][3], "", "2026-03-20 11:00:00"))
    built.capture(frame(spark, rows))
    built.capture(frame(spark, rows[:2]))
    return built


def test_errors_are_rows(engine, spark):
    rows = [("bad", "/v1/chat/completions", AUTH, "{}", "", "2026-03-20 11:00:00"), request(9, ["q"], "a")]
    errors = {r.request_id: r.error for r in engine.normalize(frame(spark, rows)).collect()}
    assert errors["r9"] is None and "missing" in errors["bad"]


def test_capture_is_idempotent_and_redacts(engine):
    assert engine.turns().count() == 1 + 2 + 3 + 1
    assert engine.captures().count() == 4
    assert engine.turns().filter(F.col("assistant_content").contains("abc123")).count() == 0
    held = engine.captures().select(F.explode("messages").alias("m")).filter(F.col("m.content").contains("abc123"))
    assert held.count() == 0


def test_search_agrees_with_scan(engine, spark):
    for query in ("skewed join", "watermark streaming rows", "nothing_at_all", ""):
        indexed = index.search(spark, f"{engine.root}/index", "turn_id", query, 10).collect()
        scanned = bm25.search(engine.turns(), F.concat_ws("\n", "user_content", "assistant_content"), query, "turn_id", 10)
        assert [tuple(r) for r in indexed] == [tuple(r) for r in scanned.select("turn_id", "score").collect()]


def test_index_with_removed_and_replaced_documents(spark, tmp_path):
    base = str(tmp_path / "index")
    first = spark.createDataFrame([("a", "red green"), ("b", "green blue blue"), ("c", ""), ("d", "red")], "id string, t string")
    index.add(first, "id", F.col("t"), base)
    second = spark.createDataFrame([("b", "yellow red"), ("e", "green")], "id string, t string")
    index.add(second, "id", F.col("t"), base, removed=spark.createDataFrame([("b",), ("d",)], "id string"))
    current = spark.createDataFrame([("a", "red green"), ("b", "yellow red"), ("c", ""), ("e", "green")], "id string, t string")
    assert {r.id for r in index.keys(spark, base, "id").collect()} == {"a", "b", "c", "e"}
    for query in ("red", "blue", "green yellow", "red green blue yellow"):
        expected = bm25.search(current, F.col("t"), query, "id", 5).select("id", "score").collect()
        assert index.search(spark, base, "id", query, 5).collect() == expected


def test_search_and_inject(engine):
    hits = engine.search_turns("skewed join key", now()).collect()
    assert hits and hits[0]["rank"] == 1 and "salt" in hits[0].user_content
    fingerprint = engine.turns().filter("turn_id like '%r0_0'").first().fingerprint
    boosted = engine.search_turns("skewed join key", now(), fingerprint=fingerprint).first()
    assert boosted.score == pytest.approx(hits[0].score * 1.5, abs=1e-5)
    row = engine.inject("skewed join key", now(), "You build pipelines.").first()
    assert row.system_prompt == f"{row.text}\n\nYou build pipelines." and row.memory_count >= 1
    assert row.token_count <= 1800
    assert engine.inject("", now()).first().text == ""


def test_injected_request(engine, spark):
    asked = frame(spark, [request(50, ["skewed join key"], "")]).select("request_id", "url", "headers", "body")
    before, after = json.loads(asked.first().body), json.loads(engine.inject_request(asked, now()).first().body)
    prompt = after["messages"][0]["content"]
    assert prompt.startswith("You build pipelines.") and "salt" in prompt
    assert after["messages"][1:] == before["messages"][1:] and after["model"] == before["model"]
    unknown = asked.withColumn("headers", F.create_map(F.lit("authorization"), F.lit("Bearer other")))
    assert engine.inject_request(unknown, now()).first().body == asked.first().body


def test_vectors_join_the_ranking(engine):
    assert engine.reconcile() == {"indexed": 0, "updated": 0, "unchanged": 7, "removed": 0, "embedded": 7}
    assert engine.reconcile()["embedded"] == 0
    vector = vectors.embed_query(engine.spark, "What is a watermark in streaming?")
    best = engine.search_turns("watermark", now(), query_vector=vector).first()
    assert best.user_content == "What is a watermark in streaming?" and best.score >= 1.0
    assert engine.search_memories("watermark").count() >= 1


def test_reconcile_catches_missed_turns(engine, spark, tmp_path):
    other = MemoryEngine(spark, str(tmp_path), CONFIG)
    engine.turns().drop("turn_date").write.parquet(f"{tmp_path}/turns/turn_date=2026-03-20")
    assert other.reconcile(embed=False)["indexed"] == 7
    again = other.reconcile(embed=False)
    assert again == {"indexed": 0, "updated": 0, "unchanged": 7, "removed": 0, "embedded": 0}


def test_reconcile_follows_edits_and_removals(engine, spark, tmp_path):
    other = MemoryEngine(spark, str(tmp_path), CONFIG)
    rows = engine.turns().drop("turn_date")
    day = f"{tmp_path}/turns/turn_date=2026-03-20"
    rows.write.parquet(day)
    other.reconcile()
    edited = F.when(F.col("turn_id") == "turn_conv_r0_0", "Pelicans fly.").otherwise(F.col("assistant_content"))
    changed = rows.filter("turn_id <> 'turn_conv_r2_2'").withColumn("assistant_content", edited)
    changed.write.mode("overwrite").parquet(day)
    assert other.reconcile() == {"indexed": 0, "updated": 1, "unchanged": 5, "removed": 1, "embedded": 1}
    assert other.stored_vectors().count() == 6
    assert other.search_turns("pelicans", now()).first().turn_id == "turn_conv_r0_0"
    assert "turn_conv_r2_2" not in {r.turn_id for r in other.search_turns("watermark streaming", now()).collect()}
    assert other.reconcile()["unchanged"] == 6


def test_incognito_leaves_nothing_behind(spark, tmp_path):
    hidden = MemoryEngine(spark, f"{tmp_path}/a", replace(CONFIG, incognito=True))
    hidden.capture(frame(spark, [request(0, ["What is a secret plan?"], "None.")]))
    assert hidden.turns().count() == hidden.captures().count() == hidden.search_turns("secret plan", now()).count() == 0
    other = MemoryEngine(spark, f"{tmp_path}/b", CONFIG)
    rows = frame(spark, [request(0, ["What is a secret plan?"], "None."), request(1, ["Open question here?"], "Yes.")])
    other.capture(rows.withColumn("incognito", F.col("request_id") == "r0"))
    assert [r.session_id for r in other.turns().collect()] == ["conv_r1"]
    assert other.search_turns("secret plan", now()).count() == 0


def test_date_limits_and_pruned_days(engine):
    day = F.to_timestamp(F.lit("2026-03-21"))
    hits = engine.search_turns("short question salt", now(), after=day).collect()
    assert all(str(r.ts) >= "2026-03-21" for r in hits)
    assert {r.session_id for r in engine.search_turns("short", now(), before=day).collect()} <= {"conv_r0", "conv_r1", "conv_r2"}
    plan = engine.search_turns("skewed join key", now())._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "turn_date" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_compressed_responses(spark, tmp_path):
    other = MemoryEngine(spark, str(tmp_path), CONFIG)
    rows = frame(spark, [request(0, ["Is it packed well?"], "It was packed."), request(1, ["Is it plain here?"], "It was plain.")])
    packed = F.udf(gzip.compress, "binary")
    data = F.encode("response", "UTF-8")
    bytes_ = F.when(F.col("request_id") == "r0", packed(data)).otherwise(data)
    encoding = F.when(F.col("request_id") == "r0", "gzip")
    other.capture(rows.withColumn("response_encoding", encoding).withColumn("response", bytes_))
    assert {r.assistant_content for r in other.turns().collect()} == {"It was packed.", "It was plain."}


def test_interrupted_index_runs_are_never_read(spark, tmp_path, monkeypatch):
    base = f"{tmp_path}/index"
    docs = spark.createDataFrame([("a", "red green"), ("b", "green blue")], "id string, t string")
    index.add(docs, "id", F.col("t"), base)
    newer = spark.createDataFrame([("a", "yellow")], "id string, t string")
    gone = newer.select("id")
    failing = newer.withColumn("t", F.when(F.col("id") == "a", F.raise_error(F.lit("stopped"))).otherwise(F.col("t")))
    for stop in (None, "publish"):
        with monkeypatch.context() as patch:
            if stop:
                patch.setattr(sinks, stop, lambda *_, **__: (_ for _ in ()).throw(RuntimeError("stopped")))
            with pytest.raises(Exception, match="stopped"):
                index.add(newer if stop else failing, "id", F.col("t"), base, removed=gone)
        assert [r.id for r in index.search(spark, base, "id", "red", 5).collect()] == ["a"]
        assert index.search(spark, base, "id", "yellow", 5).count() == 0
        assert index.keys(spark, base, "id").count() == 2
    index.add(spark.createDataFrame([("c", "blue")], "id string, t string"), "id", F.col("t"), base)
    assert {r.id for r in index.search(spark, base, "id", "red blue", 5).collect()} == {"a", "b", "c"}
    index.add(newer, "id", F.col("t"), base, removed=gone)
    assert index.search(spark, base, "id", "red", 5).count() == 0
    before = index.search(spark, base, "id", "green blue yellow", 5).collect()
    index.add(newer, "id", F.col("t"), base, buckets=3)  # indexed again: replaced, in other buckets
    assert index.current(spark, base).buckets == 3 and index.current(spark, base).documents == 3
    assert index.search(spark, base, "id", "green blue yellow", 5).collect() == before
    assert index.keys(spark, base, "id").count() == 3


def test_paths_leaving_the_folder_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([("turns/../../x.md", "c"), ("turns/y.md", "c")], "path string, content string")
    got = {r.path: r.ok for r in sinks.export_markdown(rows, f"{tmp_path}/w").collect()}
    assert got == {"turns/../../x.md": False, "turns/y.md": True} and not (tmp_path / "x.md").exists()


def test_status_and_lists(engine):
    row = engine.status().first()
    assert (row.turn_count, row.session_count, row.tool_count) == (7, 4, 1)
    assert [r.label for r in engine.date_groups(F.to_timestamp(F.lit("2026-03-22 12:00:00"))).orderBy("latest").collect()] == ["Friday", "Yesterday"]
    assert engine.list_turns("WATERMARK").count() == 1
    assert engine.turn("turn_conv_r0_0").count() == 1


def test_sessions_keep_the_fullest_capture(engine):
    assert [r.capture_id for r in engine.sessions().collect()] == ["conv_r2"]


def test_extraction(engine):
    def extractor(prompt):
        assert "## User" in prompt and "You build pipelines" not in prompt
        return json.dumps(
            {
                "facts": [
                    {"text": "Works with skewed joins", "category": "SKILL", "confidence": "HIGH"},
                    {"text": "Maybe likes streaming", "category": "PREFERENCE", "confidence": "LOW"},
                ],
                "summary_update": "talks about joins",
            }
        )

    def failing(_):
        raise RuntimeError("no service")

    failed = engine.extract(failing, lambda _: "{}", now()).first()
    assert failed.conversations_processed == 0 and failed.created == 0
    stats = engine.extract(extractor, lambda _: '{"action":"ADD"}', now()).first()
    assert (stats.conversations_processed, stats.facts_extracted, stats.created) == (1, 2, 2)
    assert engine._summary() == "talks about joins"
    again = engine.extract(extractor, lambda _: '{"action":"ADD"}', now()).first()
    assert again.conversations_processed == 0
    assert engine.memories().count() == 2
    assert [r.line for r in engine.profile_lines().collect()] == ["1. Works with skewed joins"]
    assert engine.regenerate_profile(lambda p: "PROFILE of " + p.split("\n")[-1]) == "PROFILE of 1. Works with skewed joins"
    assert engine.inject("skewed join key", now()).first().has_profile is True


def test_wallet_export(engine, spark, tmp_path):
    root = str(tmp_path)
    assert engine.export_markdown(root).filter("ok").count() == engine.turns().count() + engine.memories().count() + 4
    assert sorted(r.n for r in wallet.captures(spark, root).collect()) == [2, 2, 4, 6]
    rows = wallet.turns(spark, root).collect()
    assert len(rows) == 7 and rows[0].timestamp >= rows[-1].timestamp
    assert wallet.turn(spark, root, "turn_conv_r0_0").first().user_content.startswith("How do I")
    assert wallet.memories(spark, root).count() == engine.memories().count()
    row = wallet.status(spark, root).first()
    assert (row.turn_count, row.session_count) == (7, 4) and row.bytes > 0 and row.last_capture_at is not None


def test_wallet_reading(spark, tmp_path):
    root = str(tmp_path)
    assert wallet.scan(spark, root, "turns").count() == 0
    assert wallet.status(spark, f"{root}/none").first().turn_count == 0
    folder = tmp_path / "conversations" / "2026-01-01"
    folder.mkdir(parents=True)
    (folder / "a b+c.md").write_text("---\nid: c1\ntool: cur\nmodel: m\ntimestamp: t\nincognito: true\n---\n\n## User\nx\n\n## Assistant\ny")
    (folder / "no-id.md").write_text("plain")
    (folder / "skip.txt").write_text("---\nid: z\n---\n")
    row = wallet.captures(spark, root).collect()
    assert [(r.path, r.capture_id, r.incognito, r.n) for r in row] == [("2026-01-01/a b+c.md", "c1", True, 2)]


def test_memory_document_round_trip(spark):
    df = spark.sql(
        "SELECT 'm1' memory_id, 'text: with colon' text, 'SKILL' category, 'HIGH' confidence, 's' source, "
        "timestamp'2026-01-01' created_at, timestamp'2026-01-02' valid_from, cast(null as timestamp) invalidated_at"
    )
    back = documents.parse_memories(df.select(documents.render_memory().alias("content"))).drop("content")
    assert back.select(*df.columns).collect() == df.collect()
