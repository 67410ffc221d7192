"""Mix overlapping sources to target weights by a min-cost flow over membership patterns.

Documents are summed by the set of sources they belong to. Tokens then flow
from patterns to sources: every pattern offers its size once per repetition, a
repetition costs more the later it comes, and a source takes what its target
asks. The flow has one node per pattern and source, whatever the number of
documents. What a pattern gives is then turned into documents: whole passes
over all of them, and for the rest the documents first in a seeded order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.llm.common import WORD, stored, without

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BUCKET_BITS = 12
MAX_PATTERNS = 100_000  # patterns held on the driver; more is an error, none is left out
ADDED = ("size", "source_size", "target", "times", "taken")


def word_count(text: str) -> Column:
    return F.when(F.col(text).isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD))).cast("bigint")


def targets(sizes: dict[str | None, int], total: int, weights: Sequence[int] = WEIGHTS) -> dict[str | None, float]:
    """Share of ``total`` for each source, at most MAX_REPEATS times its size; the excess goes to the others.

    Sources stand in code point order, null last, and weigh by position.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    result: dict[str | None, float] = {}
    open_, left = list(order), float(total)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit > MAX_REPEATS * sizes[s]]
        if not full:
            return result | {s: weight[s] * unit for s in open_}
        for s in full:
            result[s] = float(MAX_REPEATS * sizes[s])
            left -= result[s]
            open_.remove(s)
    return result


def route(patterns: Sequence[tuple], sizes: Sequence[int], wanted: dict[str | None, float]) -> list[int]:
    """Tokens each pattern gives in a cheapest flow that fills the sources as far as possible.

    Only the edges into patterns cost something, 1, 2, 3, ... for a pattern's
    first, second, third repetition, and no path to the sink leaves a pattern
    backward through them. So shortest paths come in the order of repetitions:
    all that first repetitions can fill, then the second, then the third, each a
    maximum flow on top of the last. Each is found by blocking flows, which push
    along all shortest paths at once.
    """
    place = {s: 1 + len(patterns) + i for i, s in enumerate(wanted)}
    sink = 1 + len(patterns) + len(place)
    graph: list[list[int]] = [[] for _ in range(sink + 1)]
    ends: list[int] = []
    room: list[int] = []

    def edge(a: int, b: int, capacity: int) -> None:
        for start, end, own in ((a, b, capacity), (b, a, 0)):
            graph[start].append(len(ends))
            ends.append(end)
            room.append(own)

    for i in range(len(patterns)):  # edge 2 * i leads into pattern i
        edge(0, 1 + i, 0)
    for i, (members, size) in enumerate(zip(patterns, sizes, strict=True)):
        for member in members:
            edge(1 + i, place[member], MAX_REPEATS * size)
    for s, node in place.items():
        edge(node, sink, round(wanted[s]))

    for _ in range(MAX_REPEATS):
        for i, size in enumerate(sizes):
            room[2 * i] += size
        while (depth := _depths(graph, ends, room, sink)) is not None:
            _block(graph, ends, room, sink, depth)
    return [room[2 * i + 1] for i in range(len(patterns))]


def _depths(graph: list[list[int]], ends: list[int], room: list[int], sink: int) -> list[int] | None:
    """Edges from the source to each node over open edges, -1 for none; None where the sink is out of reach."""
    depth = [-1] * len(graph)
    depth[0] = 0
    front = [0]
    while front and depth[sink] < 0:
        following = []
        for node in front:
            for e in graph[node]:
                if room[e] and depth[ends[e]] < 0:
                    depth[ends[e]] = depth[node] + 1
                    following.append(ends[e])
        front = following
    return depth if depth[sink] >= 0 else None


def _block(graph: list[list[int]], ends: list[int], room: list[int], sink: int, depth: list[int]) -> None:
    """Push along shortest paths until every one of them holds a full edge."""
    tried = [0] * len(graph)
    path: list[int] = []
    node = 0
    while True:
        if node == sink:
            push = min(room[e] for e in path)
            full = 0
            for k, e in enumerate(path):
                room[e] -= push
                room[e ^ 1] += push
                if not room[e] and not full:
                    full = k + 1
            node = ends[path[full - 1] ^ 1]  # go on from where the first full edge starts
            del path[full - 1 :]
            continue
        open_ = graph[node]
        while tried[node] < len(open_):
            e = open_[tried[node]]
            if room[e] and depth[ends[e]] == depth[node] + 1:
                path.append(e)
                node = ends[e]
                break
            tried[node] += 1
        else:
            if not path:
                return
            node = ends[path.pop() ^ 1]
            tried[node] += 1


def mix(docs: DataFrame, members: Column, seed: int = 17, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """Documents with size, source_size, target, times and taken.

    ``members`` is the array of sources a document belongs to. ``times`` says
    how often the mix takes the document (0 to 3), ``taken`` is ``times`` sizes.
    ``source_size`` and ``target`` are those of the first member.

    Null or empty text has size 0 and is taken for 0 words; a null source is a
    source of its own, last in order; an empty member list belongs to the null
    source. Rows equal in doc_id and size are taken alike. An empty table gives
    an empty result. Columns of the added names are replaced, others kept.
    """
    docs = without(docs, ADDED)
    pattern = F.array_sort(F.array_distinct(F.when(F.size(members) > 0, members).otherwise(F.array(F.lit(None)))))
    order = F.xxhash64(F.col("doc_id"), F.col("size"), F.lit(seed))
    keyed = docs.withColumns({"size": word_count("text"), "_pattern": pattern.cast("array<string>")}).withColumn(
        "_order", order
    )
    keyed = keyed.withColumn("_bucket", F.shiftrightunsigned("_order", 64 - BUCKET_BITS).cast("int"))
    narrow = stored(keyed.select("_pattern", "_bucket", "_order", "size"), "mix")

    buckets = stored(narrow.groupBy("_pattern", "_bucket").agg(F.sum("size").alias("words")), "mix")
    rows = buckets.groupBy("_pattern").agg(F.sum("words").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    rows = sorted(rows, key=lambda r: [(x is None, x or "") for x in r._pattern])
    sizes: dict[str | None, int] = {}
    for r in rows:
        for s in r._pattern:
            sizes[s] = sizes.get(s, 0) + r.words
    wanted = targets(sizes, sum(r.words for r in rows), weights)
    given = route([tuple(r._pattern) for r in rows], [r.words for r in rows], wanted)
    plan = docs.sparkSession.createDataFrame(
        [
            (
                list(r._pattern),
                g // r.words if r.words else 0,
                g % r.words if r.words else 0,
                sizes[r._pattern[0]],
                wanted[r._pattern[0]],
            )
            for r, g in zip(rows, given, strict=True)
        ],
        "_pattern array<string>, passes bigint, rest bigint, source_size bigint, target double",
    )

    # The bucket of the seeded order in which the rest runs out, then the place inside it.
    before = Window.partitionBy("_pattern").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("words").over(before), F.lit(0))
    border = (
        buckets.withColumn("start", start)
        .join(F.broadcast(plan), "_pattern")
        .filter("start < rest AND start + words >= rest")
        .select("_pattern", "_bucket", "start", "rest")
    )
    upto = Window.partitionBy("_pattern", "_bucket").orderBy("_order")
    inside = (
        narrow.join(F.broadcast(border), ["_pattern", "_bucket"])
        .groupBy("_pattern", "_bucket", "_order", "start", "rest")
        .agg(F.sum("size").alias("words"))
        .withColumn("end", F.col("start") + F.sum("words").over(upto))
    )
    # A unit is taken when at least half of it fits, so the error is at most half a document.
    last = inside.groupBy("_pattern", "_bucket").agg(
        F.max(F.when(F.col("end") - F.col("words") / 2 <= F.col("rest"), F.col("_order"))).alias("last")
    )
    limits = stored(
        plan.join(last.withColumnRenamed("_bucket", "edge"), "_pattern", "left").drop("rest"), "mix"
    )
    in_rest = (F.col("_bucket") < F.col("edge")) | (
        (F.col("_bucket") == F.col("edge")) & (F.col("_order") <= F.col("last"))
    )
    times = F.col("passes") + F.coalesce(in_rest, F.lit(False)).cast("bigint")
    # One row per pattern, at most MAX_PATTERNS.
    return (
        keyed.join(F.broadcast(limits), "_pattern")
        .withColumn("times", F.when(F.col("size") > 0, times).otherwise(0))
        .withColumn("taken", F.col("times") * F.col("size"))
        .select(*docs.columns, *ADDED)
    )
