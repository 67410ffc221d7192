"""Vector scan, reciprocal rank fusion and the default hashing embedder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.functions import text as tx

RRF_K = 60  # Cormack, Clarke & Buettcher 2009
SCORE_DIGITS = 6


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, product: total + product)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def nearest(vectors: DataFrame, key: str, column: str, query: Column, limit: int) -> DataFrame:
    """(key, score): exact cosine top ``limit``; a heap per task, no shuffle of vectors."""
    prepared = vectors.select(key, F.col(column).alias("_v")).withColumn("_query", query)
    norms = norm(F.col("_v")) * norm(F.col("_query"))
    cosine = F.when(norms > 0, dot(F.col("_v"), F.col("_query")) / norms).otherwise(F.lit(0.0))
    scored = prepared.select(key, F.round(cosine, SCORE_DIGITS).alias("score"))
    return scored.orderBy(F.desc("score"), F.asc(key)).limit(limit)


def fuse(lists: list[DataFrame], key: str, limit: int, depth: int, unit: bool = False) -> DataFrame:
    """Reciprocal rank fusion of (key, score) lists, of which the first ``depth`` places count.

    ``depth`` is the length asked of the lists. ``unit`` scales scores so that the first place in every list gives 1.
    """
    scale = (RRF_K + 1.0) / len(lists) if unit else 1.0
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), F.asc(key))
    votes = [
        hits.select(key, "score").orderBy(F.desc("score"), F.asc(key)).limit(depth).withColumn("_vote", F.lit(1.0) / (F.lit(float(RRF_K)) + F.row_number().over(order)))
        for hits in lists
    ]
    merged = reduce(lambda a, b: a.unionByName(b), votes)
    fused = merged.groupBy(key).agg(F.round(F.sum("_vote") * F.lit(scale), 9).alias("score"))
    return fused.orderBy(F.desc("score"), F.asc(key)).limit(limit)


def hashed_bucket(term: Column, size: int) -> Column:
    return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint") % size).cast("int")


def hashed_weights(docs: DataFrame, key: str, body: Column, size: int) -> DataFrame:
    """(key, bucket, weight): log-scaled term counts hashed into ``size`` buckets."""
    return (
        docs.select(key, body.alias("_body"))
        .repartition(key)
        .select(key, F.explode(tx.word_tokens(F.col("_body"))).alias("term"))
        .groupBy(key, hashed_bucket(F.col("term"), size).alias("bucket"))
        .agg(F.log1p(F.count(F.lit(1)).cast("double")).alias("weight"))
    )


def embed(docs: DataFrame, key: str, body: Column, size: int = 64) -> DataFrame:
    """(key, embedding): unit-length hashed vectors, the model-free default."""
    weights = hashed_weights(docs, key, body, size)
    # At most ``size`` buckets per document reach the map.
    filled = weights.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("_w"))
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("_w", i), F.lit(0.0))
    )
    norm = F.sqrt(F.aggregate(F.map_values("_w"), F.lit(0.0), lambda acc, w: acc + w * w))
    scaled = filled.withColumn("_norm", norm).withColumn("_dense", dense)
    return scaled.select(
        key, F.transform("_dense", lambda v: (v / F.col("_norm")).cast("float")).alias("embedding")
    )


def embed_query(spark: SparkSession, query: str, size: int = 64) -> list[float]:
    """Vector of a query string under the default embedder."""
    rows = embed(spark.createDataFrame([(0, query)], "id int, t string"), "id", F.col("t"), size).head(1)
    return rows[0].embedding if rows else [0.0] * size


def lacking(docs: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Documents without a vector yet."""
    return docs.join(vectors.select(key), key, "left_anti")
