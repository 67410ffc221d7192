"""Exact top-k over pivots against a scan per query."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.operators import pivots, vectors

SCHEMA = "id bigint, embedding array<float>"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], SCHEMA)


def scan(rows, query, k):
    scored = []
    for key, v in rows:
        usable = all(x is not None and len(x) and np.isfinite(x).all() and np.any(np.asarray(x) != 0) for x in (v, query))
        if usable:
            a, b = (np.asarray(x, dtype=np.float32).astype(float) for x in (v, query))
            score = round(float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)), 6)
        scored.append((-(score if usable else 0.0), key))
    return [(key, -score) for score, key in sorted(scored)[:k]]


def compare(found, rows, asked, k):
    got = {}
    for row in found.collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["id"], row["score"]))
    assert set(got) == {i for i, _ in asked}
    for query_id, query in asked:
        own = sorted(got[query_id])
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1))
        want = scan(rows, query, k)
        assert [(i, pytest.approx(s, abs=2e-6)) for i, s in want] == [(i, s) for _, i, s in own] or sorted(
            s for _, _, s in own
        ) == pytest.approx(sorted(s for _, s in want), abs=2e-6)


def clustered(seed, clusters, each, width=16):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(clusters, width))
    return [(c * each + i, centres[c] + 0.05 * rnd.normal(size=width)) for c in range(clusters) for i in range(each)]


def ask(spark, rows, asked, k, **sizes):
    rings = pivots.build(frame(spark, rows), "id", "embedding", **sizes)
    return pivots.top_k(frame(spark, asked).withColumnRenamed("id", "query_id"), "query_id", "embedding", rings, "id", k)


@pytest.mark.parametrize(("number", "rings", "k"), [(8, 4, 5), (1, 1, 3), (3, 2, 400), (64, 8, 10)])
def test_equals_a_scan(spark, number, rings, k):
    rnd = np.random.default_rng(2)
    rows = clustered(1, 6, 20) + [(1000 + i, rnd.normal(size=16)) for i in range(60)]
    rows += [(2000 + i, rows[3][1]) for i in range(12)]  # equal vectors, ties by key
    asked = [(i, v) for i, v in rows[::17]] + [(9000 + i, rnd.normal(size=16)) for i in range(5)]
    compare(ask(spark, rows, asked, k, pivots=number, rings=rings), rows, asked, k)


def test_rows_without_direction(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [-1.0, 0.1]), (5, [float("nan"), 1.0]), (6, [0.5, 0.5])]
    asked = [(10, [1.0, 0.2]), (11, [0.0, 0.0]), (12, None), (13, [-1.0, 0.0])]
    for k in (1, 3, 10):
        compare(ask(spark, rows, asked, k), rows, asked, k)


def test_empty_tables(spark):
    some = [(1, [1.0, 0.0])]
    assert ask(spark, [], some, 3).count() == 0
    assert ask(spark, some, [], 3).count() == 0


def test_clustered_vectors_are_mostly_ruled_out(spark):
    """Rings a query visits hold less than half of the vectors."""
    rows = clustered(3, 24, 50)
    rings = pivots.build(frame(spark, rows), "id", "embedding")
    asked = frame(spark, rows[::40]).select(F.col("id").alias("_q"), F.col("embedding").alias("_u"))
    visits = pivots._visits(asked, rings, 10)
    sizes = {(p, r): n for p, r, n in zip(rings.pivot.tolist(), rings.ring.tolist(), rings.size.tolist())}
    read = sum(sizes[v["pivot"], v["ring"]] for v in visits.select("pivot", "ring").collect())
    assert read < 0.5 * asked.count() * len(rows)


def test_fused_lists_count_to_their_full_length(spark):
    """Beyond a thousand places nothing is lost."""
    hits = spark.range(1500).select("id", (1.0 / (F.col("id") + 1)).alias("score"))
    assert vectors.fuse([hits, hits], "id", 1500, depth=1500).count() == 1500
