"""Signature trees: nodes hold OR-combined token bitmaps and size ranges.

A leaf holds some sets, a node some nodes. For two nodes no pair of their sets
can share more tokens than the bits their bitmaps share, plus what collisions
inside one bitmap may hide, nor more than the smaller of the largest sizes. If
that is less than the smallest sizes need, the pair of nodes is pruned; else
their children are paired. Pairs whose sets are linked already are pruned too:
they cannot change a component.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

LEAF = 16
FAN = 8


def similar(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


class Tree:
    """Signature tree over ``sets`` (sorted distinct token arrays) in the order given by ``order``."""

    def __init__(self, sets: Sequence[np.ndarray], order: np.ndarray, bits: int):
        self.order = order
        self.sizes = np.array([len(sets[i]) for i in order], dtype=np.int64)
        maps = np.zeros((len(order), bits // 8), dtype=np.uint8)
        for row, i in enumerate(order):
            flags = np.zeros(bits, dtype=bool)
            flags[(sets[i] % np.uint64(bits)).astype(np.int64)] = True
            maps[row] = np.packbits(flags)
        self.maps = maps.view(np.uint64)
        hidden = self.sizes - np.bitwise_count(self.maps).sum(axis=1, dtype=np.int64)
        # levels[k]: bitmaps, smallest size, largest size, most tokens hidden by collisions, borders in sets
        self.levels = []
        maps, low, high = self.maps, self.sizes, self.sizes
        border, step = np.arange(len(order) + 1), LEAF
        self.hidden = hidden
        while True:
            cuts = np.arange(0, len(maps), step)
            border = np.append(border[:-1][cuts], len(order))
            maps = np.bitwise_or.reduceat(maps, cuts, axis=0)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            hidden = np.maximum.reduceat(hidden, cuts)
            self.levels.append((maps, low, high, hidden, border))
            if len(maps) == 1:
                break
            step = FAN


def _may_link(shared, hidden, low_a, high_a, low_b, high_b, percent: int):
    """Can sets of these size ranges, sharing at most ``shared`` bits, be similar?"""
    most = np.minimum(np.minimum(high_a, high_b), shared + hidden)
    return (
        (100 * high_a >= percent * low_b)
        & (100 * high_b >= percent * low_a)
        & ((100 + percent) * most >= percent * (low_a + low_b))
    )


def links(sets: Sequence[np.ndarray], left: int | None, percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the similarity graph.

    With ``left`` None all sets are compared with each other, else the first
    ``left`` sets with the others. Every link is checked on the full sets.
    """
    n = len(sets)
    if n < 2:
        return []
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    first = np.array([s[0] if len(s) else 0 for s in sets], dtype=np.uint64)
    bits = int(min(1 << 14, max(512, 1 << int(4 * np.median(sizes)).bit_length())))
    size_class = np.log(np.maximum(sizes, 1)) // np.log(100 / percent)

    def build(indexes: np.ndarray) -> Tree:
        return Tree(sets, indexes[np.lexsort((first[indexes], size_class[indexes]))], bits)

    if left is None:
        a = b = build(np.arange(n))
    else:
        if not 0 < left < n:
            return []
        a, b = build(np.arange(left)), build(np.arange(left, n))
    root = np.arange(n)
    found = []
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        maps_a, low_a, high_a, hidden_a, border_a = a.levels[la]
        maps_b, low_b, high_b, hidden_b, border_b = b.levels[lb]
        own_a = a.order[border_a[i] : border_a[i + 1]]
        own_b = b.order[border_b[j] : border_b[j + 1]]
        roots = root[own_a]
        if (roots == roots[0]).all() and (root[own_b] == roots[0]).all():
            continue
        if a is not b or i != j:
            shared = int(np.bitwise_count(maps_a[i] & maps_b[j]).sum())
            hidden = min(hidden_a[i], hidden_b[j])
            if not _may_link(shared, hidden, low_a[i], high_a[i], low_b[j], high_b[j], percent):
                continue
        if la or lb:
            down_a = range(i * FAN, min(i * FAN + FAN, len(a.levels[la - 1][0]))) if la else [i]
            down_b = range(j * FAN, min(j * FAN + FAN, len(b.levels[lb - 1][0]))) if lb else [j]
            pairs = [
                (max(la - 1, 0), x, max(lb - 1, 0), y) for x in down_a for y in down_b if a is not b or i != j or x <= y
            ]
            stack += sorted(pairs, key=lambda p: -abs(p[1] - p[3]))  # neighbours first
            continue
        rows_a = slice(border_a[i], border_a[i + 1])
        rows_b = slice(border_b[j], border_b[j + 1])
        shared = np.bitwise_count(a.maps[rows_a][:, None, :] & b.maps[rows_b][None, :, :]).sum(axis=2, dtype=np.int64)
        sa, sb = a.sizes[rows_a][:, None], b.sizes[rows_b][None, :]
        hidden = np.minimum(a.hidden[rows_a][:, None], b.hidden[rows_b][None, :])
        for x, y in np.argwhere(_may_link(shared, hidden, sa, sa, sb, sb, percent)):
            p, q = int(own_a[x]), int(own_b[y])
            if root[p] == root[q]:
                continue
            common = np.intersect1d(sets[p], sets[q], assume_unique=True).size
            if similar(common, len(sets[p]), len(sets[q]), percent):
                found.append((p, q))
                root[root == root[q]] = root[p]
    return found
