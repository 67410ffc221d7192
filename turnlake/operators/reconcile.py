"""Index maintenance: content-addressed upsert and snapshot comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions import text as tx

KEY = ["collection", "path"]
STATUSES = ("indexed", "updated", "removed", "unchanged")


def description(path: Column, content: Column) -> list[Column]:
    """path, title and hash of a file."""
    return [
        tx.normalize_path(path).alias("path"),
        tx.extract_title(content, path).alias("title"),
        tx.content_hash(content).alias("hash"),
    ]


def described(docs: DataFrame, collection: str, path: Column, content: Column) -> DataFrame:
    """Index rows (collection, path, title, hash, content) of scanned files.

    Files whose path cannot be normalised are left out; a one-row ``inline``
    keeps the path from being computed for the condition and again for the row.
    """
    row = F.struct(F.lit(collection).alias("collection"), *description(path, content), content.alias("content"))
    return docs.select(F.inline(F.array(row))).filter(F.col("path").isNotNull())


def changed(incoming: DataFrame, index: DataFrame) -> DataFrame:
    """Incoming rows that are new or differ in hash; the others need no write."""
    known = index.select(*KEY, F.col("hash").alias("_known"))
    joined = incoming.join(known, KEY, "left")
    return joined.filter(F.col("_known").isNull() | (F.col("_known") != F.col("hash"))).drop("_known")


def upsert(index: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Next index snapshot; unchanged rows keep their times."""
    columns = ["title", "hash"]
    new = incoming.select(*KEY, *[F.col(c).alias(f"_{c}") for c in columns])
    differs = F.col("_hash").isNotNull() & ~F.col("hash").eqNullSafe(F.col("_hash"))
    return index.join(new, KEY, "full_outer").select(
        *KEY,
        *[F.when(differs, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns],
        F.coalesce("created_at", now).alias("created_at"),
        F.when(differs, now).otherwise(F.col("modified_at")).alias("modified_at"),
    )


def new_contents(incoming: DataFrame, contents: DataFrame) -> DataFrame:
    """(hash, body) not stored yet. Copies collapse on the map side."""
    distinct = incoming.groupBy("hash").agg(F.any_value("content").alias("body"))
    return distinct.join(contents.select("hash"), "hash", "left_anti")


def bodies(hits: DataFrame, contents: DataFrame) -> DataFrame:
    """Attach bodies to a short hit list, '' where none is stored."""
    return hits.join(contents.select("hash", "body"), "hash", "left").withColumn(
        "body", F.coalesce("body", F.lit(""))
    )


def compare(index: DataFrame, scanned: DataFrame) -> DataFrame:
    """(collection, path, status) over the union of both snapshots."""
    old = index.select(*KEY, F.col("hash").alias("_old"))
    new = scanned.select(*KEY, F.col("hash").alias("_new"))
    status = (
        F.when(F.col("_old").isNull(), "indexed")
        .when(F.col("_new").isNull(), "removed")
        .when(F.col("_old") != F.col("_new"), "updated")
        .otherwise("unchanged")
    )
    return old.join(new, KEY, "full_outer").select(*KEY, status.alias("status"))


def counters(compared: DataFrame) -> DataFrame:
    """(status, n) with a row for every status that occurs."""
    return compared.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
