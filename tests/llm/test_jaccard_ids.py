"""N-gram join of texts that share a doc_id, against a brute-force closure."""

from __future__ import annotations

import random

import pytest

from turnlake.llm import jaccard

SCHEMA = "doc_id bigint, text string"


def shingle_set(text, width=4):
    words = text.lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def expected(rows, percent=85):
    """doc_id -> smallest id reachable; texts of one id are one node."""
    sets = [(doc_id, shingle_set(text)) for doc_id, text in rows]
    near = {doc_id: {doc_id} for doc_id, _ in rows}
    for a, x in sets:
        for b, y in sets:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                near[a].add(b)
    component = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            node = todo.pop()
            if node not in component:
                component[node] = start
                todo += near[node]
    return component


def varied(words, changed, seed):
    rnd, out = random.Random(seed), list(words)
    for i in range(changed):
        out[(i * 97 + 13) % len(out)] = f"x{seed}-{rnd.randrange(10**6)}"
    return out


@pytest.mark.parametrize("turned", [False, True])
def test_two_texts_of_one_id_link_both(spark, turned):
    """A links to B, B to C, A not to C, and A and B share an id: C belongs to it, whatever the order."""
    first = [f"w{i}" for i in range(300)]
    second = first[:20] + [f"s{i}" for i in range(15)] + first[35:]
    third = second[:200] + [f"t{i}" for i in range(15)] + second[215:]
    a, b, c = (" ".join(x) for x in (first, second, third))
    pairs = [(x, y, 100 * len(x & y) >= 85 * len(x | y)) for x, y in ((shingle_set(a), shingle_set(b)), (shingle_set(b), shingle_set(c)), (shingle_set(a), shingle_set(c)))]
    assert [hit for _, _, hit in pairs] == [True, True, False]
    rows = [(5, a), (5, b), (9, c)]
    found = jaccard.groups(spark.createDataFrame(rows[::-1] if turned else rows, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(5, 5), (5, 5), (9, 5)]


def test_random_rows_with_repeated_ids(spark):
    rnd, rows = random.Random(8), []
    bases = [[f"b{k}-{i}" for i in range(rnd.randint(4, 120))] for k in range(12)]
    for n in range(150):
        base = rnd.choice(bases)
        rows.append((rnd.randint(0, 90), " ".join(varied(base, rnd.randint(0, len(base) // 25 + 1), n))))
    want = expected(rows)
    found = jaccard.groups(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(found) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in found} == want
