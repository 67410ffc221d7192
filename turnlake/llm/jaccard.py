"""Jaccard self-join of documents over word shingles with signature trees.

1. Each text becomes a set of hashed shingles; equal sets are one from here on.
2. A set is cut by token hash into pieces, more of them than two similar sets of
   its size can differ in tokens, so such sets have whole pieces in common. Sets
   that share a piece, and whose bitmaps leave enough overlap possible, fall into
   one block.
3. A block is the unit of a signature-tree join. A block too large for a task is
   cut by size class and salt, and pairs of cells are joined; size classes too
   far apart are never paired.
4. The links, a spanning forest per cell pair, are closed to components.

No pair of similar sets is lost, no list of a block is built in one row, and the
driver holds a table of fixed size only.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import bounded_batches, components, stored
from turnlake.llm.shingles import mix, set_key, shingles
from turnlake.llm.sigtree import links

WIDTH = 4
PERCENT = 85
WHOLE_GROUP = 8  # sets sharing a piece up to which their bitmaps are compared; more are one block as they are
CLASS_BITS = 22  # buckets of the table of common tokens
RUN_TOKENS = 1_000_000  # tokens counted together
RUN_COUNT, COMMON = 3, 16  # a token is counted from so many in a run, and common from so many in all
PARTS = 1024  # parts the pieces are dealt to by hash
PIECES = 100_000  # pieces a task packs together
NODE_BITS = 48  # of a set's key that stand for it while blocks are searched
CELL_TOKENS = 2_000_000  # tokens a cell of a block may hold
FILTER_BITS = 23  # bits of the filter in front of joins that move texts


def _texts(batches, name: str = "text"):
    for batch in batches:
        yield batch, batch.column(name).to_pylist()


def bitmap(tokens: np.ndarray) -> bytes:
    """Half of the tokens, chosen by hash, in n/2 to n bits (a power of two, 64 at least)."""
    bits = max(64, 1 << (len(tokens).bit_length() - 1))
    flags = np.zeros(bits, dtype=bool)
    flags[(tokens[(tokens >> np.uint64(40)) % np.uint64(2) == 0] % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def may_be_similar(n_a: int, a: bytes, n_b: int, b: bytes, percent: int = PERCENT) -> bool:
    """Can sets of these sizes and bitmaps be similar? Each bit that one lacks is a token it lacks."""
    if percent * max(n_a, n_b) > 100 * min(n_a, n_b):
        return False
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    bits = 8 * min(len(a), len(b))
    x, y = _folded(x, bits, len(a)), _folded(y, bits, len(b))
    shared = min(n_a - (x & ~y).bit_count(), n_b - (y & ~x).bit_count())
    return (100 + percent) * shared >= percent * (n_a + n_b)


def _folded(value: int, bits: int, size: int) -> int:
    """Bitmap of ``size`` bytes OR-ed down to ``bits`` bits."""
    width = 8 * size
    while width > bits:
        width //= 2
        value = (value >> width) | (value & ((1 << width) - 1))
    return value


def set_keys(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n, key, check, bits): size of the set, two hashes of it and its bitmap."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch, texts in _texts(batches):
            sets = [shingles(t, width) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s, 1) for s in sets], pa.int64()),
                    pa.array([set_key(s, 7) for s in sets], pa.int64()),
                    pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "n", "key", "check", "bits"],
            )

    schema = f"doc_id {kind}, n bigint, key bigint, check bigint, bits binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def common_tokens(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """Whether a hash bucket holds a token of many texts. Fixed size.

    Tokens are counted in runs of RUN_TOKENS, and those a run hardly has are
    dropped there. The table decides which pieces are sent first, not what is found.
    """
    bits = CLASS_BITS

    def counted(held):
        tokens = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]))
        counts = np.diff(first, append=len(tokens))
        often = counts >= RUN_COUNT
        buckets = (tokens[first[often]] >> np.uint64(64 - bits)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(counts[often])], ["bucket", "n"])

    def run(batches):
        held, size = [], 0
        for _, texts in _texts(batches):
            for text in texts:
                held.append(shingles(text, width))
                size += len(held[-1])
                if size >= RUN_TOKENS:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    rows = docs.select("text").mapInArrow(run, "bucket int, n bigint")
    found = rows.groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON).select("bucket").toArrow()
    table = np.zeros(1 << bits, dtype=bool)
    table[found.column("bucket").to_numpy()] = True
    return table


@functools.cache
def size_classes(percent: int) -> np.ndarray:
    """Smallest sizes of the classes; similar sets are of one class or of neighbouring ones."""
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(bounds[-1] * 100 // percent + 1)
    return np.array(bounds, dtype=np.int64)


@functools.lru_cache(256)
def _places(family: int, pieces: int) -> np.ndarray:
    return mix(np.arange(pieces, dtype=np.uint64), 1000 + family)


def pieces(tokens: np.ndarray, common: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Marks of pieces of a set, such that similar sets that are not equal have one in common.

    A family holds two neighbouring size classes. Two similar sets of it differ
    in at most ``most`` tokens, so of more pieces, cut by token hash, all but
    ``most`` are equal. In an order that both follow, the first ``most + 1`` of
    each then share one; pieces with many tokens, rare ones above all, are first.
    """
    if not len(tokens) or percent >= 100:
        return np.empty(0, dtype=np.uint64)
    bounds = size_classes(percent)
    own = int(np.searchsorted(bounds, len(tokens), side="right")) - 1
    often = common[(tokens >> np.uint64(65 - len(common).bit_length())).astype(np.int64)]
    weight = np.concatenate([[0], np.cumsum(np.where(often, 1, 8))])
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(tokens, 11), dtype=np.uint64)])
    high = tokens >> np.uint64(32)
    found = []
    for family in (own - 1, own):
        most = 2 * int(bounds[family + 2] - 1) * (100 - percent) // (100 + percent) if family >= 0 else 0
        if not most:
            continue  # similar sets of these sizes are equal
        number = most + 1 + max(2, most // 5)
        ends = np.cumsum(np.bincount(((high * np.uint64(number)) >> np.uint64(32)).astype(np.int64), minlength=number))
        starts = np.concatenate([[0], ends[:-1]])
        rank = np.uint64(127) - np.minimum(weight[ends] - weight[starts], 127).astype(np.uint64)
        mark = mix(total[ends] - total[starts] + _places(family, number), 12)
        found.append(np.partition((rank << np.uint64(57)) | (mark >> np.uint64(7)), most)[: most + 1])
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint64)


def _six(values: np.ndarray) -> np.ndarray:
    """The low six bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]


def piece_rows(docs: DataFrame, common: np.ndarray, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(part, rows): pieces of the texts by hash, packed as six bytes of the mark and six of the set's key."""
    shipped = docs.sparkSession.sparkContext.broadcast(common)

    def packed(marks, nodes, sizes):
        mark = np.concatenate(marks)
        node = np.repeat(np.array(nodes, dtype=np.uint64), sizes)
        part = (mark % np.uint64(PARTS)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        rows = np.hstack([_six(mark // np.uint64(PARTS)), _six(node)])[order]
        ends = np.cumsum(np.bincount(part, minlength=PARTS))
        used = np.flatnonzero(np.diff(ends, prepend=0))
        blobs = [rows[a:b].tobytes() for a, b in zip(np.concatenate([[0], ends[:-1]])[used], ends[used], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "rows"])

    def run(batches):
        marks, nodes, sizes, held = [], [], [], 0
        for _, texts in _texts(batches):
            done: set[tuple[int, int]] = set()
            for text in texts:
                own = shingles(text, width)
                both = set_key(own, 1), set_key(own, 7)
                if both in done:
                    continue
                done.add(both)
                marks.append(pieces(own, shipped.value, percent))
                nodes.append(both[0] & ((1 << NODE_BITS) - 1))
                sizes.append(len(marks[-1]))
                held += sizes[-1]
                if held >= PIECES:
                    yield packed(marks, nodes, sizes)
                    marks, nodes, sizes, held = [], [], [], 0
        if held:
            yield packed(marks, nodes, sizes)

    return docs.select("text").mapInArrow(run, "part int, rows binary")


def _sharing(rows: bytes, whole: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, look) of the sets that share a piece: all pairs of few, of many each with the first of them."""
    both = np.frombuffer(rows, dtype=np.uint8).reshape(-1, 2, 6)
    wide = np.zeros((len(both), 2, 8), dtype=np.uint8)
    wide[:, :, :6] = both
    wide = wide.reshape(-1, 16).view("<u8")
    mark, node = wide[:, 0], wide[:, 1]
    order = np.argsort(mark)
    mark, node = mark[order], node[order]
    same = mark[1:] == mark[:-1]
    kept = np.append(same, False) | np.append(False, same)
    mark, node = mark[kept], node[kept]
    order = np.lexsort((node, mark))
    mark, node = mark[order], node[order]
    new = np.append(True, (mark[1:] != mark[:-1]) | (node[1:] != node[:-1]))[: len(mark)]
    mark, node = mark[new], node[new].astype(np.int64)
    first = np.flatnonzero(np.append(True, mark[1:] != mark[:-1])[: len(mark)])
    sizes = np.diff(np.append(first, len(mark)))
    start, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    place = np.arange(len(mark)) - start
    few = size <= whole
    us, vs, looks = [], [], []
    for step in range(1, whole):
        at = np.flatnonzero(few & (place >= step))
        us.append(node[at - step])
        vs.append(node[at])
        looks.append(np.ones(len(at), dtype=bool))
    at = np.flatnonzero(~few & (place > 0))
    us.append(node[start[at]])
    vs.append(node[at])
    looks.append(np.zeros(len(at), dtype=bool))
    u, v, look = np.concatenate(us), np.concatenate(vs), np.concatenate(looks)
    order = np.lexsort((look, v, u))
    u, v, look = u[order], v[order], look[order]
    new = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))[: len(u)]
    return u[new], v[new], look[new]


def blocks(rows: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component): the block of every set that may be similar to another.

    ``rows`` has the pieces, ``sets`` node, n and bits. Sets sharing a piece are
    compared by bitmap, and what may be similar is chained. The few pieces of
    many sets chain all their sets without a look; a block is only where to search.
    """
    ordered = rows.repartition("part").sortWithinPartitions("part")
    whole = WHOLE_GROUP

    def run(batches):
        part, held = None, []
        for batch in batches:
            for own, packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != part:
                    if held:
                        yield _pair_batch(*_sharing(b"".join(held), whole))
                    part, held = own, []
                held.append(packed)
        if held:
            yield _pair_batch(*_sharing(b"".join(held), whole))

    found = ordered.mapInArrow(run, "u bigint, v bigint, look boolean")
    pairs = stored(found.groupBy("u", "v").agg(F.min("look").alias("look")), "pairs")
    left = sets.select(F.col("node").alias("u"), F.col("n").alias("n_u"), F.col("bits").alias("bits_u"))
    right = sets.select(F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("bits").alias("bits_v"))

    def look(batches):
        for batch in batches:
            u, v, *own = [c.to_pylist() for c in batch.columns]
            hits = [may_be_similar(*x, percent) for x in zip(*own, strict=True)]
            yield _edge_batch([p for p, hit in zip(zip(u, v, strict=True), hits, strict=True) if hit])

    looked = pairs.filter("look").join(left, "u").join(right, "v").select("u", "v", "n_u", "bits_u", "n_v", "bits_v")
    chained = pairs.filter("NOT look").select("u", "v")
    return components(chained.union(looked.mapInArrow(look, "u bigint, v bigint")))


def _pair_batch(u: np.ndarray, v: np.ndarray, look: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(look)], ["u", "v", "look"])


def _edge_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())}
    )


def _cells(members: DataFrame, percent: int) -> DataFrame:
    """Members with ``task`` (cell pair) and ``side`` (0 left, 1 right, 2 alone), once per cell pair they are in."""
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")
    members = members.withColumn("class", size_class)
    totals = members.groupBy("block", "class").agg(F.sum("n").alias("tokens"))
    whole = totals.groupBy("block").agg(F.sum("tokens").alias("all"))
    salts = F.ceil(F.col("tokens") / CELL_TOKENS).cast("int")
    large = stored(
        totals.join(whole.filter(F.col("all") > CELL_TOKENS), "block").select("block", "class", salts.alias("salts")),
        "cells",
    )

    def beside(step: int, name: str) -> DataFrame:
        return large.select("block", (F.col("class") - step).alias("class"), F.col("salts").alias(name))

    around = large.join(beside(1, "above"), ["block", "class"], "left").join(
        beside(-1, "below"), ["block", "class"], "left"
    )
    placed = members.join(around, ["block", "class"], "left").withColumn(
        "salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int"))
    )

    def tasks(count: str, pair) -> Column:
        numbers = F.sequence(F.lit(0), F.coalesce(F.col(count), F.lit(0)) - 1)
        return F.when(F.coalesce(F.col(count), F.lit(0)) > 0, F.transform(numbers, pair)).otherwise(F.array())

    def cell(*parts) -> Column:
        return F.concat_ws("/", F.col("block").cast("string"), *[F.col(p) if isinstance(p, str) else p for p in parts])

    same = tasks(
        "salts",
        lambda j: F.struct(
            cell("class", F.least("salt", j), F.greatest("salt", j)).alias("task"),
            F.when(j == F.col("salt"), 2).when(F.col("salt") < j, 0).otherwise(1).alias("side"),
        ),
    )
    up = tasks("above", lambda j: F.struct(cell("class", "salt", F.lit("up"), j).alias("task"), F.lit(0).alias("side")))
    down = tasks(
        "below",
        lambda j: F.struct(cell(F.col("class") - 1, j, F.lit("up"), "salt").alias("task"), F.lit(1).alias("side")),
    )
    alone = F.array(F.struct(F.col("block").cast("string").alias("task"), F.lit(2).alias("side")))
    every = F.when(F.col("salts").isNull(), alone).otherwise(F.concat(same, up, down))
    return placed.select("rep", "key", "check", F.explode(every).alias("t")).select("rep", "key", "check", "t.task", "t.side")


def marked(rows: DataFrame, name: str, ids: DataFrame, id_name: str) -> DataFrame:
    """``rows`` with ``_maybe``: false only if its id is none of ``ids``.

    A broadcast table of 2^FILTER_BITS bits, so no row moves.
    """

    def place(own: str) -> tuple[Column, Column]:
        at = F.pmod(F.xxhash64(F.col(own).cast("bigint")), F.lit(1 << FILTER_BITS))
        return F.shiftright(at, 6), at.bitwiseAND(F.lit(63))

    word, bit = place(id_name)
    words = ids.select(word.alias("_word"), bit.cast("int").alias("_bit"))
    words = words.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    word, bit = place(name)
    held = rows.withColumn("_word", word).join(F.broadcast(words), "_word", "left")
    hit = F.coalesce(F.getbit("_bits", bit) == 1, F.lit(False))
    return held.withColumn("_maybe", hit).drop("_word", "_bits")


def links_of(docs: DataFrame, members: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(u, v): links between representatives; ``members`` has block, rep, key, check and n."""
    members = stored(members, "members")
    texts = marked(docs.select("doc_id", "text"), "doc_id", members, "rep").filter("_maybe").drop("_maybe")
    cells = _cells(members, percent)
    rows = texts.join(cells, texts["doc_id"] == cells["rep"]).select("task", "side", "rep", "key", "check", "text")
    ordered = rows.repartition("task").sortWithinPartitions("task", "side", "rep")

    def closed(group):
        """Links of one cell pair: group holds (side, rep, set)."""
        left = sum(side == 0 for side, _, _ in group)
        alone = group[0][0] == 2
        for p, q in links([s for _, _, s in group], None if alone else left, percent):
            yield group[p][1], group[q][1]

    def run(batches):
        task, group, seen = None, [], set()
        for batch in batches:
            found = []
            for own, side, rep, key, check, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != task:
                    found += closed(group) if group else []
                    task, group, seen = own, [], set()
                tokens = shingles(text, width)
                # Other rows may carry the same doc_id; each text that made a key counts, once.
                if set_key(tokens, 1) == key and set_key(tokens, 7) == check and (rep, key, check) not in seen:
                    seen.add((rep, key, check))
                    group.append((side, rep, tokens))
            yield _edge_batch(found)
        yield _edge_batch(list(closed(group)) if group else [])

    return ordered.mapInArrow(run, "u bigint, v bigint")


def _links_of_ids(keys: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): a doc_id with several sets, and what stands for each of them."""
    own = keys.filter("n > 0 AND doc_id IS NOT NULL").withColumn("u", F.col("doc_id").cast("bigint"))
    mark = F.struct("key", "check")
    several = own.groupBy("u").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).filter("low <> high").select("u")
    linked = own.join(several, "u").join(sets.drop("bits", "node"), ["n", "key", "check"])
    return linked.select("u", F.col("rep").alias("v")).filter("u <> v")


def groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    component_id is the smallest doc_id reachable over links of similar sets,
    itself included. doc_id must be an integer; its null rows get a null
    component unless a document with an id has the same set. Rows of one doc_id
    with different texts are one document: what links to either belongs to it.
    Null or empty text has no shingle, and links with nothing. Texts of any length are read whole.
    Repeated rows come back repeated. An empty table gives an empty one. Other
    columns are not read.
    """
    bounded_batches(docs.sparkSession)
    keys = stored(set_keys(docs, width), "keys")
    # Key and check together, 128 bits, stand for a set; the key alone only for the block to search.
    identity = ["n", "key", "check"]
    sets = stored(
        keys.filter("n > 0")
        .groupBy(*identity)
        .agg(F.min("doc_id").cast("bigint").alias("rep"), F.first("bits").alias("bits"))
        .withColumn("node", F.col("key").bitwiseAND(F.lit((1 << NODE_BITS) - 1))),
        "sets",
    )
    block = blocks(piece_rows(docs, common_tokens(docs, width), width, percent), sets, percent)
    members = (
        sets.filter("rep IS NOT NULL")
        .join(block, "node")
        .select(F.col("component").alias("block"), "rep", "key", "check", "n")
    )
    closed = components(links_of(docs, members, width, percent).union(_links_of_ids(keys, sets)))
    named = sets.join(closed, sets["rep"] == closed["node"], "left").select(
        *identity, F.coalesce("component", "rep").alias("component_id")
    )
    joined = keys.join(named, identity, "left")
    own = F.col("doc_id").cast("bigint")
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, own).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents that stand for their group: those whose doc_id is the component's.

    Documents without a shingle all stay, as do rows without a doc_id. Of rows
    that repeat a doc_id all stay if that id stays.
    """
    gone = groups(docs, width, percent).filter("n_shingles > 0 AND doc_id <> component_id").select("doc_id").distinct()
    gone = stored(gone, "gone")
    every = marked(docs, "doc_id", gone, "doc_id")
    stay = every.filter("NOT _maybe").select(*docs.columns)
    doubtful = every.filter("_maybe").select(*docs.columns)
    return stay.union(doubtful.join(gone, "doc_id", "left_anti").select(*docs.columns))
