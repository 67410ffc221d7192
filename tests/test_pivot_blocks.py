"""The vector join over several blocks of queries, and what it leaves on disk."""

from __future__ import annotations

import os

import numpy as np

from test_pivots import ask, clustered, compare
from turnlake.operators import pivots
from turnlake.session import shared_dir


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(pivots, "QUERY_NUMBERS", 400)
    rows = clustered(5, 6, 20) + [(900, None), (901, [0.0] * 16)] + [(1000 + i, clustered(5, 6, 20)[i % 3][1]) for i in range(30)]
    compare(ask(spark, rows, rows, 4, pivots=8, rings=4), rows, rows, 4)


def test_visits_do_not_reach_the_disk(spark):
    """Without clusters nearly every ring is open to every query."""
    def size():
        root = shared_dir(spark).removeprefix("file:")
        return sum(os.path.getsize(os.path.join(folder, f)) for folder, _, files in os.walk(root) for f in files)

    rnd = np.random.default_rng(6)
    rows = [(i, rnd.normal(size=16)) for i in range(800)]
    before = size()
    assert ask(spark, rows, rows, 3).count() == 2400
    assert size() - before < 3_000_000
