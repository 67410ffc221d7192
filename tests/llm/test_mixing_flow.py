"""Flow of the source mix against an exhaustive minimum, and its speed on many sources."""

from __future__ import annotations

import itertools
import random
import time

from turnlake.llm import mixing


def filled(patterns, given, wanted):
    """Tokens that reach sources when patterns give so much: exhaustive over cuts, so exact."""
    names = list(wanted)
    best = None
    for r in range(len(names) + 1):
        for inside in itertools.combinations(names, r):
            # A cut: sources inside are paid by their targets, patterns that touch a source outside by what they give.
            cost = sum(round(wanted[s]) for s in inside)
            cost += sum(g for p, g in zip(patterns, given) if not set(p) <= set(inside))
            best = cost if best is None else min(best, cost)
    return best


def cost_of(given, sizes):
    return sum(r * max(0, min(size, g - (r - 1) * size)) for g, size in zip(given, sizes) for r in range(1, mixing.MAX_REPEATS + 1))


def test_flow_is_the_cheapest_of_the_largest():
    rnd = random.Random(4)
    for _ in range(150):
        names = "abc"[: rnd.randint(1, 3)]
        patterns = [p for r in range(1, len(names) + 1) for p in itertools.combinations(names, r) if rnd.random() < 0.7][:4]
        if not patterns:
            continue
        sizes = [rnd.randint(0, 2) for _ in patterns]
        wanted = {s: float(rnd.randint(0, 7)) for s in names}
        given = mixing.route(patterns, sizes, wanted)
        assert all(0 <= g <= mixing.MAX_REPEATS * size for g, size in zip(given, sizes))
        choices = list(itertools.product(*[range(mixing.MAX_REPEATS * size + 1) for size in sizes]))
        whole = [c for c in choices if filled(patterns, c, wanted) == sum(c)]  # all that is given arrives
        most = max(map(sum, whole))
        assert sum(given) == most and filled(patterns, given, wanted) == most
        assert cost_of(given, sizes) == min(cost_of(c, sizes) for c in whole if sum(c) == most)


def test_many_sources_take_seconds():
    rnd = random.Random(5)
    names = [f"s{i}" for i in range(30_000)]
    patterns = [(n,) for n in names] + [tuple(sorted(rnd.sample(names, 2))) for _ in range(20_000)]
    sizes = [rnd.randint(1, 1000) for _ in patterns]
    own = dict.fromkeys(names, 0)
    for p, size in zip(patterns, sizes):
        for s in p:
            own[s] += size
    wanted = mixing.targets(own, sum(sizes))
    started = time.perf_counter()
    given = mixing.route(patterns, sizes, wanted)
    assert time.perf_counter() - started < 60
    assert sum(given) <= sum(map(round, wanted.values())) and all(g <= 3 * size for g, size in zip(given, sizes))
