"""Helpers the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from turnlake.session import bounded_batches, fresh_dir

FOREST_EDGES = 1_000_000  # edges a task closes together
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` written to the shared folder and read back: fixed, and cheap to read again."""
    path = fresh_dir(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def without(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns an operator is about to add; an operator's own columns win over equal names."""
    return rows.drop(*names)


def with_arrow_columns(
    rows: DataFrame, compute: Callable[[pa.RecordBatch], Sequence[pa.Array]], fields: pa.Schema
) -> DataFrame:
    """``rows`` with the columns ``compute`` makes from each Arrow batch, one value per row."""
    bounded_batches(rows.sparkSession)
    rows = without(rows, fields.names)

    def run(batches):
        for batch in batches:
            yield appended(batch.columns, batch.schema.names, compute(batch), fields)

    return rows.mapInArrow(run, extended(rows.schema, fields))


def extended(schema: StructType, fields: pa.Schema) -> StructType:
    """A Spark schema with Arrow fields behind."""
    return StructType([*schema.fields, *from_arrow_schema(fields).fields])


def appended(columns: Sequence[pa.Array], names: Sequence[str], more: Sequence[pa.Array], fields: pa.Schema) -> pa.RecordBatch:
    """A batch of columns as they came, and new ones behind."""
    return pa.RecordBatch.from_arrays([*columns, *more], [*names, *fields.names])


def string_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _stored_with_mark(edges: DataFrame, label: str) -> tuple[DataFrame, tuple]:
    """Edges in the shared folder, with their count and an order-free checksum, taken while they are written."""
    mixed = F.xxhash64("u", "v")
    mark = Observation()
    parts = F.sum(F.shiftright(mixed, 20)), F.sum(mixed.bitwiseAND(F.lit((1 << 20) - 1)))
    written = stored(edges.observe(mark, F.count(F.lit(1)).alias("n"), parts[0].alias("high"), parts[1].alias("low")), label)
    return written, tuple(mark.get.get(name) for name in ("n", "high", "low"))


def _forest(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Edges (u, v) that hang each node on the smallest it reaches over the edges given."""
    kind = held[0].schema.field("u").type
    every = [batch.column(name).to_numpy(zero_copy_only=False) for name in ("u", "v") for batch in held]
    nodes, ends = np.unique(np.concatenate(every), return_inverse=True)
    a, b = np.split(ends, 2)
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    hung = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[hung], kind), pa.array(nodes[root[hung]], kind)], ["u", "v"])


def _forests(batches):
    """Forests of FOREST_EDGES edges at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= FOREST_EDGES:
            yield _forest(held)
            held, size = [], 0
    if size:
        yield _forest(held)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (u, v), for every node with a link.

    Alternating large-star and small-star rounds: each hangs nodes on the
    smallest node they know, so path lengths fall by a power and a few rounds do
    for any shape. A round is two aggregations with map-side combining and two
    equi-joins; a node with very many neighbours is a skewed join key, which AQE
    splits, never a list. Every round is a table in the shared folder. Before the
    first, tasks close what they hold, so that fewer rounds are needed.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    edges, seen = _stored_with_mark(stored(edges, "links").mapInArrow(_forests, edges.schema).distinct(), "edges")
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(smallest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # After the large star every edge points from a node to a smaller one.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            joined.select("u", F.col("m").alias("v"))
        )
        edges, mark = _stored_with_mark(small.filter("u <> v").distinct(), "edges")
        if mark == seen:
            break
        seen = mark
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
