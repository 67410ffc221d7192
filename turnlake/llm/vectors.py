"""Near-duplicate vectors by tile products of Int8 quantised vectors.

Vectors of one label are dealt into tiles; every pair of tiles of a label is one
product of two Int8 matrices. Each vector carries the exact length of its
quantisation error, which bounds how far a product of quantised vectors can be
from the true cosine. Only pairs whose bound reaches the threshold are computed
again in double precision. A tile pair hands on link counts and a spanning
forest of its links, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import components, stored, without

THRESHOLD = 0.98
TILE = 4096  # vectors of a tile: a task holds two
STRIP = 1024  # rows and columns of a tile multiplied at a time
ROUNDING = 1e-9  # allowance for rounding in the bound itself
ADDED = ("n_links", "component_id", "kept")


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 values, step and length of the error of each row of unit vectors."""
    step = np.abs(unit).max(axis=1, initial=0.0) / 127.0
    small = np.rint(unit / step[:, None]).astype(np.int8)
    return small, step, np.linalg.norm(unit - small * step[:, None], axis=1)


def bounds(a, b) -> np.ndarray:
    """Upper bound of the cosines of two quantised tiles."""
    (qa, sa, ea), (qb, sb, eb) = a, b
    # Products and sums of Int8 values are whole numbers far below 2**24 for up to 1040 dimensions,
    # so single precision holds them exactly; longer vectors take double precision.
    kind = np.float32 if qa.shape[1] <= 1040 else np.float64
    product = qa.astype(kind) @ qb.astype(kind).T
    return product * (sa[:, None] * sb[None, :]) + (ea[:, None] + eb[None, :] + ea[:, None] * eb[None, :] + ROUNDING)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def pair_links(ids_a, unit_a, ids_b, unit_b, same: bool, threshold: float):
    """Link counts of both tiles and forest edges as index pairs (b counts on from the rows of a)."""
    n_a = len(ids_a)
    counts_a, counts_b = np.zeros(n_a, dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
    root = np.arange(n_a if same else n_a + len(ids_b))
    edges = []
    quant_a, quant_b = quantise(unit_a), quantise(unit_b)
    for i in range(0, n_a, STRIP):
        rows = slice(i, i + STRIP)
        for j in range(i if same else 0, len(ids_b), STRIP):
            columns = slice(j, j + STRIP)
            maybe = bounds([x[rows] for x in quant_a], [x[columns] for x in quant_b]) >= threshold
            maybe &= ids_a[rows][:, None] != ids_b[columns][None, :]
            if same and i == j:
                maybe = np.triu(maybe, 1)
            x, y = np.nonzero(maybe)
            if not len(x):
                continue
            exact = np.einsum("ij,ij->i", unit_a[rows][x], unit_b[columns][y]) >= threshold
            x, y = x[exact] + i, y[exact] + j
            counts_a += np.bincount(x, minlength=n_a)
            (counts_a if same else counts_b)[:] += np.bincount(y, minlength=len(ids_b))
            far = y if same else y + n_a
            while True:  # one edge between two trees at a time
                open_ = np.flatnonzero(root[x] != root[far])
                if not len(open_):
                    break
                x, far = x[open_], far[open_]
                edges.append((x[0], far[0]))
                root[root == root[far[0]]] = root[x[0]]
    return counts_a, counts_b, edges


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows with n_links, component_id and kept, besides their own columns.

    Vectors are compared when labels are equal and not null. A vector that is
    null, empty, all zero or holds a null, infinite or NaN component, a null
    label or a null vec_id links with nothing; vectors of different length do
    not link. Equal rows are one vector; rows that share a vec_id but differ
    share links. An empty table gives an empty one. Columns of the added names
    are replaced, others kept.
    """
    vectors = without(vectors, ADDED)
    usable = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.col("embedding").isNotNull()
        & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    )
    rows = (
        vectors.filter(usable)
        .select(
            F.col("vec_id").cast("bigint").alias("vec_id"),
            F.struct("label", F.size("embedding").alias("size")).alias("kind"),
            F.col("embedding").cast("array<double>").alias("embedding"),
        )
        .distinct()
    )
    rows = stored(rows, "vectors")
    tiles = rows.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    # One row per label and length; Spark broadcasts it only while it is small.
    dealt = rows.join(tiles, "kind").withColumn("tile", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    paired = dealt.select("*", other).select(
        F.struct("kind", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")).alias("pair"),
        (F.col("tile") > F.col("other")).alias("second"),
        "vec_id",
        "embedding",
    )

    def links(key, found):
        second = found.column("second").to_numpy()
        ids = found.column("vec_id").to_numpy()
        flat = found.column("embedding").combine_chunks().flatten().to_numpy()
        unit = unit_rows(flat.reshape(len(ids), -1))
        same = key[0].as_py()["i"] == key[0].as_py()["j"]
        if same:
            a = b = (ids, unit)
        else:
            a, b = (ids[~second], unit[~second]), (ids[second], unit[second])
        counts_a, counts_b, edges = pair_links(*a, *b, same, threshold)
        every = a[0] if same else np.concatenate([a[0], b[0]])
        counts = counts_a if same else np.concatenate([counts_a, counts_b])
        hit = np.flatnonzero(counts)
        u = np.array([every[x] for x, _ in edges], dtype=np.int64)
        v = np.array([every[y] for _, y in edges], dtype=np.int64)
        return pa.table(
            {
                "u": np.concatenate([every[hit], u]),
                "n": np.concatenate([counts[hit], np.zeros(len(u), dtype=np.int64)]),
                "v": pa.concat_arrays([pa.nulls(len(hit), pa.int64()), pa.array(v)]),
            }
        )

    found = stored(paired.groupBy("pair").applyInArrow(links, "u bigint, n bigint, v bigint"), "links")
    counts = found.filter("v IS NULL").groupBy(F.col("u").alias("_id")).agg(F.sum("n").alias("n_links"))
    groups = components(found.filter("v IS NOT NULL").select("u", "v"))
    results = counts.join(groups, counts["_id"] == groups["node"]).select("_id", "n_links", F.col("component").alias("_c"))
    own = F.col("vec_id").cast("bigint")
    joined = vectors.join(results, own == F.col("_id"), "left")
    component = F.when(own.isNotNull(), F.coalesce("_c", own))
    return joined.select(
        *vectors.columns,
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        (own.isNull() | (own == component)).alias("kept"),
    )
