"""Blocks of the n-gram join: none is lost, and what only shares a passage is not searched together."""

from __future__ import annotations

import numpy as np
import pytest

from turnlake.llm import common, jaccard, sigtree


@pytest.mark.parametrize("percent", [50, 80, 85, 99])
def test_similar_sets_share_a_piece(percent):
    rng = np.random.default_rng(percent)
    checked = 0
    for n in [*range(1, 60), *rng.integers(60, 2000, 200).tolist()] * 2:
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        most = n * (100 - percent) // 100 + 1
        left = a[rng.permutation(n)[rng.integers(0, most + 1) :]]
        b = np.unique(np.concatenate([left, rng.integers(0, 1 << 64, rng.integers(0, most + 1), dtype=np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if shared < max(n, len(b)) and sigtree.similar(shared, n, len(b), percent):
            common = rng.random(1 << 8) < 0.3
            assert np.intersect1d(jaccard.pieces(a, common, percent), jaccard.pieces(b, common, percent)).size
            checked += 1
    assert checked > 50


def test_a_common_passage_does_not_chain_texts(spark, monkeypatch):
    """Counts of a large corpus that tell no token from another, and a passage in more sets than are looked at."""
    monkeypatch.setattr(jaccard, "WHOLE_GROUP", 2)
    monkeypatch.setattr(jaccard, "frequency_classes", lambda *a: np.zeros(1 << 17, dtype=np.uint8), raising=False)
    monkeypatch.setattr(jaccard, "common_tokens", lambda *a: np.zeros(1 << 17, dtype=bool), raising=False)
    searched, links_of = [], jaccard.links_of

    def counted(docs, members, *rest):
        searched.append(members.count())
        return links_of(docs, members, *rest)

    monkeypatch.setattr(jaccard, "links_of", counted)
    passage = [f"p{i}" for i in range(30)]
    rows = [(k, " ".join([f"a{k}-{i}" for i in range(100)] + passage + [f"b{k}-{i}" for i in range(100)])) for k in range(300)]
    rows.append((300, rows[7][1] + " more"))
    found = {r["doc_id"]: r["component_id"] for r in jaccard.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {k: k for k in range(300)} | {300: 7}
    assert 2 <= searched[0] < 100


@pytest.mark.parametrize("kind", ["bigint", "int"])
def test_marked_rows_are_few_and_hold_all(spark, kind):
    rows = spark.range(20_000).selectExpr(f"CAST(id AS {kind}) AS doc_id", "'t' AS text")
    rows = rows.union(spark.createDataFrame([(None, "t")], f"doc_id {kind}, text string"))
    ids = spark.createDataFrame([(i,) for i in (3, 500, 19_999)], "rep bigint")
    every = jaccard.marked(rows, "doc_id", ids, "rep")
    assert every.count() == 20_001 and every.filter("_maybe IS NULL").isEmpty()
    hit = {r["doc_id"] for r in every.filter("_maybe").collect()}
    assert {3, 500, 19_999} <= hit and len(hit) < 100


def test_keep_one_moves_only_rows_that_may_go(spark):
    same = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, same, "x"), (2, same, None), (None, same, "y"), (3, "something else of its own stands here", "z"), (4, "", "w"), (4, None, "v")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in rows} - {(2, same, None)}
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    moved = plan[plan.index("LeftAnti") :]
    assert "_maybe" in moved or "getbit" in moved


@pytest.mark.parametrize("kind", ["bigint", "int", "string"])
def test_tasks_close_their_edges(spark, monkeypatch, kind):
    """A long path takes few rounds, as tasks close what they hold first."""
    rounds, stored = [], common._stored_with_mark
    monkeypatch.setattr(common, "_stored_with_mark", lambda *a: rounds.append(1) or stored(*a))
    edges = spark.range(1000, 1400).selectExpr(f"CAST(id AS {kind}) AS u", f"CAST(id + 1 AS {kind}) AS v").coalesce(1)
    got = common.components(edges)
    assert [f.dataType.simpleString() for f in got.schema] == [kind, kind]
    assert sorted((int(r["node"]), int(r["component"])) for r in got.collect()) == [(i, 1000) for i in range(1000, 1401)]
    assert len(rounds) == 2
