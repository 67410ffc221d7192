"""Operators on small literal tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from turnlake.config import InjectionConfig
from turnlake.operators import bm25, documents, memories, packing, rerank, sessions, similarity, slices, turns, vectors
from turnlake.plans import search

MESSAGES = "conv_id bigint, turn bigint, role string, text string"


def talk(spark, *rows):
    """rows: (conv, role, text) in order."""
    seen, listed = {}, []
    for conv, role, text in rows:
        seen[conv] = seen.get(conv, -1) + 1
        listed.append((conv, seen[conv], role, text))
    return spark.createDataFrame(listed, MESSAGES)


def pairs_of(df):
    return [(r.turn_index, r.user_content, r.assistant_content) for r in turns.turn_pairs(df).orderBy("conv_id", "turn_index").collect()]


@pytest.mark.parametrize(
    "roles, expected",
    [
        ("s u a", [(0, "u1", "a2")]),
        ("u a u", [(0, "u0", "a1")]),
        ("u a a", [(0, "u0", "a1")]),
        ("u u a", [(0, "u1", "a2")]),
        ("u s a", [(0, "u0", "a2")]),
        ("a u a u a", [(0, "u1", "a2"), (1, "u3", "a4")]),
        ("s", []),
    ],
)
@pytest.mark.parametrize("bits", [12, 1, 0])
def test_pairing(spark, monkeypatch, roles, expected, bits):
    monkeypatch.setattr(slices, "SLICE_BITS", bits)
    names = {"s": "system", "u": "user", "a": "assistant"}
    df = talk(spark, *[(1, names[r], f"{r}{i}") for i, r in enumerate(roles.split())])
    assert pairs_of(df) == expected
    array = df.groupBy().agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m")).select(
        F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("m")
    )
    inline = array.select(F.inline(turns.pairs_in_array(F.col("m")))).collect()
    assert [tuple(r) for r in inline] == expected


@pytest.mark.parametrize("bits", [12, 2, 1, 0])
def test_sliced_operators_against_python(spark, monkeypatch, bits):
    """One conversation holds most rows; every slice size gives the same numbers."""
    monkeypatch.setattr(slices, "SLICE_BITS", bits)
    rng = random.Random(bits)
    rows = []
    for conv, length in ((1, 60), (2, 3), (3, 1), (4, 9)):
        rows += [(conv, t, rng.choice(["user", "assistant", "system"]), f"{conv}-{t}") for t in range(length) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, MESSAGES)
    expected_pairs, expected_orphans = [], []
    for conv in (1, 2, 3, 4):
        spoken = [r for r in rows if r[0] == conv and r[2] != "system"]
        used, index = set(), 0
        for a, b in zip(spoken, spoken[1:]):
            if a[2] == "user" and b[2] == "assistant":
                expected_pairs.append((conv, index, a[3], b[3]))
                used |= {a[1], b[1]}
                index += 1
        expected_orphans += [(conv, r[1], r[2]) for r in spoken if r[1] not in used]
    assert sorted(tuple(r) for r in turns.turn_pairs(df).collect()) == sorted(expected_pairs)
    assert sorted(tuple(r) for r in turns.orphan_messages(df).collect()) == sorted(expected_orphans)
    records = turns.capture_records(df)
    again = records.select("conv_id", "first_index", F.inline(turns.pairs_in_array(F.col("messages"))))
    got = again.select("conv_id", F.col("first_index") + F.col("turn_index"), "user_content", "assistant_content")
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected_pairs)


CAPTURES = [("a", "cur", 2, 1), ("b", "cur", 4, 2), ("c", "cur", 6, 3), ("d", "cur", 2, 4), ("e", "oth", 4, 5), ("f", "cur", 8, 6)]


@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_sessions(spark, monkeypatch, limit):
    monkeypatch.setattr(sessions, "MAX_PLAIN_GROUP", limit)
    rows = [(p, 1, tool, n, ts, "big", False) for p, tool, n, ts in CAPTURES]
    rows += [("g", 1, "cur", 9, 7, "big", True), ("h", 1, "cur", 2, 8, "tiny-haiku", False)]
    df = spark.createDataFrame(rows, "capture_id string, wallet_id bigint, tool string, n bigint, t bigint, model string, incognito boolean")
    df = df.withColumn("ts", F.timestamp_seconds("t")).drop("t")
    numbered = sessions.assign_sessions(df, "haiku")
    assert {r.capture_id: r.session_no for r in numbered.collect()} == {"a": 1, "b": 1, "c": 1, "d": 2, "e": 3, "f": 4}
    kept = sessions.representatives(numbered)
    assert {(r.capture_id, r.n) for r in kept.collect()} == {("c", 6), ("e", 4), ("f", 8)}
    done = spark.createDataFrame([("e",), ("e",)], "capture_id string")
    assert {r.capture_id for r in sessions.pending(kept, done).collect()} == {"c", "f"}


HITS = "turn_id string, session_id string, user_content string, assistant_content string, score double"


def kept_ids(spark, rows):
    df = spark.createDataFrame(rows, HITS)
    return sorted(r.turn_id for r in rerank.drop_near_duplicates(df, search.compared_text(), "turn_id").collect())


def test_near_duplicates(spark):
    same = "alpha beta gamma delta"
    assert kept_ids(spark, [("1", "s", same, same, 0.9), ("2", "s", same, same, 0.7)]) == ["1"]
    assert kept_ids(spark, [("1", "s", same, same, 0.9), ("2", "t", same, same, 0.7)]) == ["1", "2"]
    assert kept_ids(spark, [("1", "s", same, "x", 0.9), ("2", "s", "other words", "y", 0.7)]) == ["1", "2"]
    assert kept_ids(spark, [("1", "s", "", "", 0.9), ("2", "s", "", "!", 0.7)]) == ["1"]


def test_dropped_hit_drops_nothing(spark):
    """A~B and B~C but not A~C: A removes B, C stays."""
    word = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [("A", "s", word(0, 40), "", 0.9), ("B", "s", word(3, 43), "", 0.8), ("C", "s", word(6, 46), "", 0.7)]
    assert kept_ids(spark, rows) == ["A", "C"]


def turn_rows(spark, rows):
    schema = "turn_id string, session_id string, user_content string, assistant_content string, ts timestamp, fingerprint string, score double"
    return spark.createDataFrame(rows, "turn_id string, session_id string, user_content string, assistant_content string, day string, fingerprint string, score double").select(
        "turn_id", "session_id", "user_content", "assistant_content", F.to_timestamp("day").alias("ts"), "fingerprint", "score"
    ).to(spark.createDataFrame([], schema).schema)


def now():
    return F.to_timestamp(F.lit("2026-04-01"))


@pytest.mark.parametrize("day, base, expected", [("2026-04-01", 0.6, 0.78), ("2026-01-31", 0.6, 0.66), ("2025-12-22", 0.5, 0.5)])
def test_recency_in_search(spark, day, base, expected):
    hits = turn_rows(spark, [("1", "s", "q", "a", day, "default", base)])
    assert search.rerank_turns(hits, now()).first().score == pytest.approx(expected)


def test_context_threshold_limit_and_bad_time(spark):
    rows = [("low", "s1", "one", "x", "2020-01-01", "default", 0.2), ("proj", "s2", "two", "y", "2020-01-01", "abc", 0.6), ("other", "s3", "three", "z", "2020-01-01", "default", 0.8)]
    hits = turn_rows(spark, rows)
    got = search.rerank_turns(hits, now(), min_score=0.5, fingerprint=F.lit("abc")).orderBy("rank").collect()
    assert [(r.turn_id, r.score) for r in got] == [("proj", pytest.approx(0.9)), ("other", pytest.approx(0.8))]
    plain = search.rerank_turns(hits, now(), min_score=0.5, fingerprint=F.lit("default")).orderBy("rank").collect()
    assert [r.turn_id for r in plain] == ["other", "proj"]
    many = turn_rows(spark, [(f"{i:02d}", f"s{i}", f"u{i}", "a", "2020-01-01", "default", 0.9) for i in range(20)])
    assert search.rerank_turns(many, now()).count() == 8
    assert search.rerank_turns(hits.withColumn("ts", F.lit(None).cast("timestamp")), now()).count() == 0


def entries(spark, n, user="What is it?", answer="It is a thing."):
    rows = [(f"{i:02d}", f"s{i}", user, answer, "2026-03-20", "default", 1.0 - i / 100) for i in range(n)]
    return packing.turn_entries(turn_rows(spark, rows))


def test_injection_block(spark):
    empty = packing.injection_block(entries(spark, 0)).first()
    assert (empty.text, empty.token_count, empty.memory_count, empty.has_profile) == ("", 0, 0, False)
    only_profile = packing.injection_block(entries(spark, 0), " me ").first()
    assert only_profile.text == "<recalled_context>\n\n## About You\nme\n\n## Relevant Past Conversations\n\n</recalled_context>"
    one = packing.injection_block(entries(spark, 1)).first()
    assert "[2026-03-20] You: What is it?\n→ It is a thing." in one.text
    assert one.token_count == -(-len(one.text) // 4)
    two = packing.injection_block(entries(spark, 6), config=InjectionConfig(max_turns=2)).first()
    assert two.memory_count == 2
    none = packing.injection_block(entries(spark, 3), config=InjectionConfig(max_tokens=5)).first()
    assert none.memory_count == 0 and none.text.startswith("<recalled_context>")


@pytest.mark.parametrize("budget", [40, 60, 100, 200])
def test_packing_is_the_longest_prefix(spark, budget):
    rng = random.Random(budget)
    rows = [(f"{i:02d}", f"s{i}", "q" * rng.randint(1, 90), "a", "2026-03-20", "default", 1.0 - i / 100) for i in range(8)]
    config = InjectionConfig(max_tokens=budget)
    packed = packing.pack(packing.turn_entries(turn_rows(spark, rows)), config=config).orderBy("position").collect()
    room = max(0, budget - -(-len(packing.skeleton("")) // 4))
    taken = 0
    for i, row in enumerate(rows):
        text = f"[2026-03-20] You: {row[2]}\n→ a"
        cost = -(-(len(text) + (2 if i else 0)) // 4)
        if cost > room:
            break
        room -= cost
        taken += 1
    assert [r.position for r in packed] == list(range(1, taken + 1))


def test_into_system_prompt(value):
    both = lambda a, b: value(lambda x, y: packing.into_system_prompt(x, y), a, b)
    assert both("orig", "block") == "block\n\norig"
    assert both("orig", "") == "orig"
    assert both(None, "block") == "block"
    assert both(None, "") == ""


DOC = "---\nid: c1\ntool: cur\nmodel: m\ntimestamp: 2026-01-01T00:00:00.000Z\nincognito: false\n---\n\n"


def test_clean_and_count(value):
    body = (
        DOC + "## System\nrules\n\n## User\n<system-reminder>x</system-reminder>\n\n"
        "## User\nhello <memory_context>a\nb</memory_context>there, a long enough line\n\n## Assistant\nfine\n\n## User\nshort"
    )
    cleaned = value(documents.clean_session, body)
    assert cleaned == "## User\nhello there, a long enough line\n\n## Assistant\nfine\n\n## User\nshort"
    assert value(documents.message_count, body) == 4
    assert value(documents.has_substantive_content, cleaned) is False
    longer = cleaned + " but this one is long as well"
    assert value(documents.has_substantive_content, longer) is True
    assert value(lambda c: documents.has_substantive_content(c, compat=True), longer) is False
    assert value(documents.clean_session, DOC + "## Users\nno section\n\n## User\nyes") == "## User\nyes"


def test_conversation_head(value):
    head = value(documents.parse_conversation_head, DOC + "## User\nx")
    assert (head.id, head.tool, head.model, head.incognito, head.n_messages) == ("c1", "cur", "m", False, 1)
    assert value(documents.parse_conversation_head, "no front matter").id is None


def test_conversation_golden(spark):
    df = talk(spark, (7, "system", "S"), (7, "user", "Hello!"), (7, "assistant", "Hi there!"))
    attributes = {
        "tool": F.lit("cursor"), "provider": F.lit("openai"), "model": F.lit("m1"),
        "ts": F.to_timestamp(F.lit("2026-03-20 14:30:00")), "incognito": F.lit(False),
    }
    sections = documents.conversation_sections(df, attributes).orderBy("turn").collect()
    assert "\n\n".join(r.text for r in sections) == (
        "---\nid: conv_7\ntool: cursor\nprovider: openai\nmodel: m1\ntimestamp: 2026-03-20T14:30:00.000Z\n"
        "tokenEstimate: 18\nincognito: false\n---\n\n## System\nS\n\n## User\nHello!\n\n## Assistant\nHi there!"
    )


def test_strict_and_lenient_turn_parsing(spark):
    good = "---\nid: t1\nsessionId: s1\ntool:\ntimestamp: 2026-01-01T00:00:00Z\nturnIndex: 3\n---\n\n## User\n q \n\n## Assistant\n a\nb \n"
    rows = [(good,), ("garbage",), ("---\nid: t2\n---\n\n## User\nx",)]
    df = spark.createDataFrame(rows, "content string")
    strict = documents.parse_turns(df).collect()
    assert [(r.turn_id, r.tool, r.turn_index, r.user_content, r.assistant_content, r.fingerprint) for r in strict] == [("t1", "", 3, "q", "a\nb", "default")]
    assert sorted(r.turn_id for r in documents.parse_turns_lenient(df).collect()) == ["t1", "t2"]


@pytest.mark.parametrize(
    "answer, expected",
    [
        ('{"action":"ADD"}', ("ADD", None, None)),
        ('{"action":"UPDATE","targetId":"m1"}', ("UPDATE", "m1", None)),
        ('{"action":"UPDATE"}', ("ADD", None, None)),
        ('```json\n{"action":"INVALIDATE","targetId":"m2"}\n```', ("INVALIDATE", "m2", None)),
        ('{"action":"NOOP"}', ("NOOP", None, "Already captured")),
        ('{"action":"NOOP","reason":"known"}', ("NOOP", None, "known")),
        ('{"action":"MERGE"}', ("ADD", None, None)),
        ("not json", ("ADD", None, None)),
        ("", ("ADD", None, None)),
    ],
)
def test_decisions(value, answer, expected):
    assert tuple(value(memories.parse_decision, answer)) == expected


def test_facts(spark):
    payload = '```json\n{"facts":[{"text":" a ","category":"SKILL","confidence":"HIGH"},{"text":"b","category":"MOOD","confidence":"HIGH"},{"text":"c","category":"EVENT","confidence":"SURE"},{"text":"","category":"EVENT","confidence":"LOW"},{"category":"EVENT"}],"summary_update":" s "}\n```'
    df = spark.createDataFrame([("1", payload), ("2", "nope"), ("3", '{"x":1}')], "id string, content string")
    got = memories.parse_facts(df).collect()
    assert [(r.id, r.fact_no, r.text, r.category, r.confidence, r.summary_update) for r in got] == [("1", 0, "a", "SKILL", "HIGH", "s")]
    errors = {r.id: r.e for r in df.select("id", memories.facts_error(F.col("content")).alias("e")).collect()}
    assert errors == {"1": None, "2": "not JSON", "3": "facts array missing"}


def test_profile_lines_when_cut_into_slices(spark):
    rows = [(f"m{i:03d}", "w", f"text {i}", "EVENT", "HIGH" if i % 2 else "LOW", i) for i in range(40)]
    df = spark.createDataFrame(rows, "memory_id string, wallet_id string, text string, category string, confidence string, t bigint")
    df = df.withColumn("created_at", F.timestamp_seconds("t")).withColumn("invalidated_at", F.when(F.col("t") == 5, F.col("created_at")))
    expected = [f"{n}. text {i}" for n, i in enumerate([i for i in range(40) if i % 2 and i != 5], 1)]
    for limit in (1_000_000, 1):
        lines = memories.profile_lines(df, limit=limit).orderBy("n").collect()
        assert [r.line for r in lines] == expected


def brute_force(queries, docs, k):
    import math
    import re

    split = lambda s: [w for w in re.split(r"\W+", s.lower()) if w]
    tokens = {d: split(t) for d, t in docs}
    n, avgdl = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = {}
    for words in tokens.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    result = []
    for q, text in queries:
        scored = []
        for d, words in tokens.items():
            shared = set(split(text)) & set(words)
            if shared:
                raw = sum(
                    math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * words.count(w) * 2.2
                    / (words.count(w) + 1.2 * (0.25 + 0.75 * len(words) / avgdl))
                    for w in shared
                )
                scored.append((-round(raw / (1 + raw), 6), d))
        result += [(q, d, -s, i) for i, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return result


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_join_against_brute_force(spark, seed):
    """Word frequencies fall off sharply, so common words are really set aside."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(f"d{i:03d}", text(rng.randint(3, 40))) for i in range(150)]
    queries = [(f"q{i:02d}", text(rng.randint(1, 25))) for i in range(40)] + [("none", "zzz")]
    found = similarity.top_k_join(
        spark.createDataFrame(queries, "q string, t string"), "q", F.col("t"),
        spark.createDataFrame(docs, "d string, t string"), "d", F.col("t"), 5,
    )
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute_force(queries, docs, 5))


def test_bm25_empty_query_and_unknown_words(spark):
    docs = spark.createDataFrame([("1", "a b"), ("2", "c")], "id string, t string")
    assert bm25.search(docs, F.col("t"), "!!", "id", 5).count() == 0
    assert bm25.search(docs, F.col("t"), "zzz", "id", 5).count() == 0
    assert [r.id for r in bm25.search(docs, F.col("t"), "C", "id", 5).collect()] == ["2"]


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    query = F.array(F.lit(1.0), F.lit(0.0))
    assert [(r.id, r.score) for r in vectors.nearest(df, "id", "v", query, 3).collect()] == [(1, 1.0), (3, 0.707107), (2, 0.0)]
    docs = spark.createDataFrame([(1, "x y x"), (9, "x")], "id bigint, t string")
    missing = vectors.embed(vectors.lacking(docs, df, "id"), "id", F.col("t"), 8).collect()
    assert [r.id for r in missing] == [9] and sum(v * v for v in missing[0].embedding) == pytest.approx(1.0)
