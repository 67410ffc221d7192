"""Persisted inverted index: plain Parquet snapshots.

A snapshot holds ``postings`` (term, key, tf, dl and carried columns, in
partitions by a hash of the term and sorted by (term, key) inside, so that a
query term is found by partition and row-group pruning while a frequent one
spreads over several files), ``docs`` (key, dl, hash of the text) and
``figures`` (number of documents, their length, number of buckets).

An update is a Spark job from one snapshot to the next: postings of removed and
re-indexed documents drop out by an anti-join, new ones are added. A snapshot
counts once it is listed (``sources.sinks``), so what an interrupted update left
is never read, and readers keep the snapshot they began with. Document
frequencies are counted from the postings a query reads, so nothing has to be
kept in step.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.functions import text as tx
from turnlake.operators import bm25, slices
from turnlake.sources import sinks

BUCKETS = 16  # for a small store; thousands suit a large one
WORD_BYTES = 8  # of a text, a word with what parts it from the next
FIGURES = "n bigint, dl bigint, buckets int"


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def body_hash(body: Column) -> Column:
    return F.sha2(body, 256)


@dataclass(frozen=True)
class Snapshot:
    """The newest complete snapshot and its figures; no folder before the first update."""

    folder: str | None = None
    documents: int = 0
    length: int = 0
    buckets: int = 0


def current(spark: SparkSession, base: str) -> Snapshot:
    folder = sinks.current_folder(spark, base)
    if folder is None:
        return Snapshot()
    row = spark.read.schema(FIGURES).parquet(f"{folder}/figures").first()
    return Snapshot(folder, row.n, row.dl, row.buckets)


def _postings(spark: SparkSession, snapshot: Snapshot, key: str, key_type: str, carry: str = "") -> DataFrame:
    carried = f"{carry}, " if carry else ""
    schema = f"{key} {key_type}, {carried}dl bigint, term string, tf bigint, bucket int"
    return spark.read.schema(schema).parquet(f"{snapshot.folder}/postings")


def _docs(spark: SparkSession, snapshot: Snapshot, key: str, key_type: str) -> DataFrame:
    return spark.read.schema(f"{key} {key_type}, hash string, dl bigint").parquet(f"{snapshot.folder}/docs")


def _write(postings: DataFrame, docs: DataFrame, key: str, base: str, buckets: int, tasks: int) -> None:
    """The next snapshot; ``postings`` get their bucket here."""
    spark = docs.sparkSession
    folder = sinks.new_folder(base)
    placed = postings.withColumn("bucket", bucket_of(F.col("term"), buckets))
    ordered = placed.repartitionByRange(tasks, "bucket", "term", key).sortWithinPartitions("bucket", "term", key)
    ordered.write.partitionBy("bucket").parquet(f"{folder}/postings")
    docs.write.parquet(f"{folder}/docs")
    held = spark.read.schema(docs.schema).parquet(f"{folder}/docs")
    sums = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl"), F.lit(buckets).alias("buckets")]
    held.agg(*sums).write.parquet(f"{folder}/figures")
    sinks.publish(spark, base, folder)


def add(
    docs: DataFrame,
    key: str,
    body: Column,
    base: str,
    removed: DataFrame | None = None,
    buckets: int = BUCKETS,
    carry: Sequence[str] = (),
) -> None:
    """Bring documents into the index; those it holds already are replaced, and ``removed`` names keys to drop.

    Columns named in ``carry`` are stored with every posting, to restrict a
    search and to come back with its hits; they stay the same from one update
    to the next. The index comes out in ``buckets`` buckets. An update rewrites
    the index, so documents should come in batches.
    """
    spark = docs.sparkSession
    before = current(spark, base)
    if before.folder is not None and removed is None and docs.isEmpty():
        return
    size = slices.text_bytes(docs, body)
    tasks = slices.tasks_for(size + before.length * WORD_BYTES, spark)
    postings = (
        docs.select(key, *carry, body.alias("_body"))
        .repartition(slices.tasks_for(size, spark), key)
        .select(key, *carry, tx.word_tokens(F.col("_body")).alias("_words"))
        .select(key, *carry, F.size("_words").cast("bigint").alias("dl"), F.explode("_words").alias("term"))
        .groupBy(key, *carry, "dl", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    described = docs.select(key, body_hash(body).alias("hash"), F.size(tx.word_tokens(body)).cast("bigint").alias("dl"))
    if before.folder is not None:
        key_type = docs.schema[key].dataType.simpleString()
        carried = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry)
        stale = docs.select(key)
        stale = (stale if removed is None else stale.unionByName(removed.select(key))).distinct()
        kept = _postings(spark, before, key, key_type, carried).drop("bucket").repartition(tasks, key).join(stale, key, "left_anti")
        postings = kept.unionByName(postings)
        described = _docs(spark, before, key, key_type).join(stale, key, "left_anti").unionByName(described)
    _write(postings, described, key, base, buckets, tasks)


def keys(spark: SparkSession, base: str, key: str, key_type: str = "string") -> DataFrame:
    """(key, hash) of the documents the index holds; no posting is read."""
    snapshot = current(spark, base)
    if snapshot.folder is None:
        return spark.createDataFrame([], f"{key} {key_type}, hash string")
    return _docs(spark, snapshot, key, key_type).select(key, "hash")


def search(
    spark: SparkSession,
    base: str,
    key: str,
    query: str,
    limit: int,
    key_type: str = "string",
    carry: str = "",
    where: Column | None = None,
) -> DataFrame:
    """(key, carried columns, score) of the best ``limit`` documents; reads the query terms' buckets only.

    ``where`` is a condition on carried columns; statistics are those of the
    whole index.
    """
    terms = tx.query_terms(query)
    snapshot = current(spark, base)
    carried = [part.split()[0] for part in carry.split(",")] if carry else []
    if not terms or not snapshot.documents:
        return spark.createDataFrame([], f"{key} {key_type}, " + (f"{carry}, " if carry else "") + "score double")
    places = F.col("bucket").isin([bucket_of(F.lit(t), snapshot.buckets) for t in terms])
    read = _postings(spark, snapshot, key, key_type, carry).filter(places & F.col("term").isin(terms))
    # One count per query term, taken in the same query.
    frequencies = read.agg(F.struct(*[F.count_if(F.col("term") == t).alias(f"t{i}") for i, t in enumerate(terms)])).scalar()
    n = F.lit(float(snapshot.documents))
    weights = [
        (F.col("term") == t, bm25.idf(n, F.col(f"_df.t{i}").cast("double"))) for i, t in enumerate(terms)
    ]
    idf = reduce(lambda chain, weight: chain.when(*weight), weights[1:], F.when(*weights[0]))
    average = snapshot.length / snapshot.documents
    weight = idf * bm25.saturated_tf(F.col("tf"), F.col("dl"), F.lit(average))
    found = read if where is None else read.filter(where)
    scored = (
        found.withColumn("_df", frequencies)
        .select(key, *carried, weight.alias("w"))
        .groupBy(key, *carried)
        .agg(F.round(bm25.squash(F.sum("w")), bm25.SCORE_DIGITS).alias("score"))
    )
    return scored.orderBy(F.desc("score"), F.asc(key)).limit(limit)
