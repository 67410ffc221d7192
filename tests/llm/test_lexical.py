"""Lexical search against plain Python, and DuckDB on a small table."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from turnlake.llm import lexical

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def terms(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def expected(docs, items, top=10):
    counted = [(doc_id, Counter(terms(text)), len(terms(text))) for doc_id, text in docs]
    counted = [c for c in counted if c[2]]
    total, length = len(counted), sum(c[2] for c in counted)
    df = Counter(term for _, own, _ in counted for term in own)
    found = []
    for item_id, text in items:
        scored = []
        for doc_id, own, n in counted:
            m = 100 - 75 + ((75 * n * total) // length)
            score = 0
            for term in terms(text):
                if own[term]:
                    weight = math.floor(1000 * math.log((2 * total + 2) / (2 * df[term] + 1)))
                    score += weight * ((1000000000 * own[term]) // (1000 * own[term] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        found += [(item_id, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored)[:top])]
    return sorted(found, key=repr)


def result(frame):
    assert frame.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in frame.collect()], key=repr)


def corpus(seed, size):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(4000)] + ["Éa", "CAPS", "x-y", "日本"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 60)))) for i in range(size)]
    docs += [(size + i, docs[3][1]) for i in range(40)]  # copies score alike
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 25)))) for i in range(30)]
    return docs, items


@pytest.mark.parametrize(
    ("short", "stride", "segment"), [(2048, 2048, 16384), (0, 16, 100), (30, 64, 150), (10**9, 2048, 16384), (5, 1, 37)]
)
def test_equals_a_full_scan_whatever_is_short(spark, monkeypatch, short, stride, segment):
    """All lists long, all short, and between; one segment and many."""
    for name, value in (("SHORT_POSTINGS", short), ("STRIDE", stride), ("SEGMENT_DOCS", segment)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = corpus(4, 600)
    found = lexical.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS))
    assert result(found) == expected(docs, items)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_CHARS", 400)
    docs, items = corpus(9, 80)
    found = lexical.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS).repartition(2), top=3)
    assert result(found) == expected(docs, items, 3)


def test_skipping_leaves_documents_unvisited(monkeypatch):
    """A common list is skipped through once rare terms have set the score to beat."""
    import numpy as np

    seen = []
    at = lexical.List.at
    monkeypatch.setattr(lexical.List, "at", lambda self, docs: seen.append((len(self.docs), len(docs))) or at(self, docs))
    n = 50_000
    common = lexical.List(np.arange(n, dtype=np.int32), np.full(n, 5, dtype=np.int64), 5)
    rare = lexical.List(np.arange(0, n, 1000, dtype=np.int32), np.full(50, 900, dtype=np.int64), 900)
    best = lexical.Best(10)
    lexical.search_segment([common, rare], n, best, np.arange(n, dtype=object))
    assert best.scores.tolist() == [905] * 10 and best.ids.tolist() == [1000 * i for i in range(10)]
    looked = sum(docs for size, docs in seen if size == n)
    assert looked < n / 4


def test_awkward_rows(spark):
    docs = [(1, None), (2, ""), (3, "!!!"), (None, "alpha beta"), (4, "alpha beta"), (5, "alpha beta"), (5, "alpha beta")]
    docs += [(6, "Alpha " * 50000 + "gamma"), (7, "delta")]
    items = [(1, "ALPHA alpha beta"), (2, None), (3, ""), (4, "nothing known"), (None, "beta"), (5, "delta."), (6, "ünder")]
    more = {c: F.lit("x") for c in ("number", "score", "rank", "ids")}
    frames = spark.createDataFrame(docs, DOCS).withColumns(more), spark.createDataFrame(items, ITEMS).withColumns(more)
    assert result(lexical.search(*frames)) == expected(docs, items)
    twice = items + [(1, "gamma")]
    assert result(lexical.search(frames[0], spark.createDataFrame(twice, ITEMS))) == expected(docs, twice)


def test_empty_tables(spark):
    some, none = spark.createDataFrame([(1, "a")], DOCS), spark.createDataFrame([], DOCS)
    item, no_item = spark.createDataFrame([(1, "a")], ITEMS), spark.createDataFrame([], ITEMS)
    for docs, items in ((some, no_item), (none, item), (none, no_item)):
        assert result(lexical.search(docs, items)) == []
