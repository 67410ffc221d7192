"""Overlapping passages of documents: their vectors, the best passage of a document, and re-ranking.

A long text has one vector per passage; a document is as near to a question as
its nearest passage, which is an aggregate with map-side combining. A passage
the model fails on is a row with an error; the other passages of its document
stay searchable, and the failed ones are tried again by the next run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from turnlake.operators import vectors

SIZE = 1600  # code points of a passage
OVERLAP = 240  # code points two neighbours share
MODEL_BATCH = 64  # passages a model is given at once

Model = Callable[[list[str]], Sequence[Sequence[float]]]
Scorer = Callable[[str, list[str]], Sequence[float]]


def cut(docs: DataFrame, key: str, body: Column, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, passage, start, text): passages of ``size`` code points, each ``overlap`` into its neighbour.

    The last passage holds what is left; null and empty texts have none.
    """
    step = size - overlap
    more = F.ceil((F.length("_body") - size) / F.lit(float(step))).cast("bigint")
    numbers = F.sequence(F.lit(0).cast("bigint"), F.greatest(more, F.lit(0).cast("bigint")))
    texts = docs.select(key, body.alias("_body")).filter(F.length("_body") > 0)
    numbered = texts.select(key, "_body", F.explode(numbers).alias("passage"))
    start = (F.col("passage") * step).cast("bigint")
    return numbered.select(
        key, "passage", start.alias("start"), F.substring("_body", (start + 1).cast("int"), F.lit(size)).alias("text")
    )


def _try(model: Model, texts: list[str]) -> Iterator[tuple[list[float] | None, str | None]]:
    """(vector, error) of each text; texts that fail together are tried by halves, down to single ones."""
    try:
        found = [[float(x) for x in vector] for vector in model(texts)]
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
        yield from ((vector, None) for vector in found)
    except Exception as error:  # noqa: BLE001 - whatever a model raises belongs to its texts
        if len(texts) == 1:
            yield None, f"{type(error).__name__}: {error}"
            return
        half = len(texts) // 2
        yield from _try(model, texts[:half])
        yield from _try(model, texts[half:])


def embed(passages: DataFrame, key: str, model: Model | None = None, size: int = 64) -> DataFrame:
    """(key, passage, start, embedding, error): one row per passage.

    ``model`` turns a list of texts into as many vectors; it runs in Arrow
    batches beside the data. Without a model the hashed default is used, which
    cannot fail; a passage without any word has neither vector nor error.
    """
    place = [key, "passage", "start"]
    if model is None:
        named = passages.select(F.struct(*place).alias("_place"), "text")
        embedded = vectors.embed(named, "_place", F.col("text"), size)
        found = embedded.select("_place.*", "embedding")
        return passages.select(*place).join(found, place, "left").withColumn("error", F.lit(None).cast("string"))
    fields = [StructField("embedding", ArrayType(FloatType())), StructField("error", StringType())]
    schema = StructType([*passages.select(*place).schema.fields, *fields])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, MODEL_BATCH):
                batch = whole.slice(at, MODEL_BATCH)
                results = list(_try(model, batch.column("text").to_pylist()))
                made = [pa.array([v for v, _ in results], pa.list_(pa.float32())), pa.array([e for _, e in results], pa.string())]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in place], *made], [*place, "embedding", "error"])

    return passages.select(*place, "text").mapInArrow(run, schema)


def counters(embedded: DataFrame, key: str) -> DataFrame:
    """One row: docs_processed, chunks_embedded, errors. Documents count once, failed passages or not."""
    return embedded.groupBy(key).agg(F.count("embedding").alias("_ok"), F.count("error").alias("_bad")).agg(
        F.count(F.lit(1)).alias("docs_processed"),
        F.coalesce(F.sum("_ok"), F.lit(0)).cast("bigint").alias("chunks_embedded"),
        F.coalesce(F.sum("_bad"), F.lit(0)).cast("bigint").alias("errors"),
    )


def best(embedded: DataFrame, key: str, query: Column) -> DataFrame:
    """(key, score, passage, start): each document's nearest passage, the first of equals."""
    prepared = embedded.filter(F.col("embedding").isNotNull()).withColumn("_query", query)
    norms = vectors.norm(F.col("embedding")) * vectors.norm(F.col("_query"))
    cosine = F.when(norms > 0, vectors.dot(F.col("embedding"), F.col("_query")) / norms).otherwise(F.lit(0.0))
    scored = prepared.select(key, "passage", "start", F.round(cosine, vectors.SCORE_DIGITS).alias("score"))
    order = F.struct(F.col("score"), (-F.col("passage")).alias("_first"), F.col("start"))
    return scored.groupBy(key).agg(F.max(order).alias("_best")).select(
        key, F.col("_best.score").alias("score"), (-F.col("_best._first")).alias("passage"), F.col("_best.start").alias("start")
    )


def nearest(embedded: DataFrame, key: str, query: Column, limit: int) -> DataFrame:
    """The ``limit`` documents with the nearest passages; ties by key."""
    return best(embedded, key, query).orderBy(F.desc("score"), F.asc(key)).limit(limit)


def with_best(hits: DataFrame, embedded: DataFrame, key: str, query: Column) -> DataFrame:
    """Hits, a bounded number, with best_passage and best_start; null where a document has no vector."""
    own = embedded.join(F.broadcast(hits.select(key)), key, "left_semi")
    places = best(own, key, query).select(key, F.col("passage").alias("best_passage"), F.col("start").alias("best_start"))
    return hits.join(places, key, "left")


def rerank(hits: DataFrame, question: str, text: str, scorer: Scorer) -> DataFrame:
    """Hits, at most twice the limit of a search, with the score a model gives to (question, text).

    A hit without text, or one the scorer fails on, keeps its score and goes behind the others.
    """
    schema = StructType([f for f in hits.schema.fields if f.name not in ("score", "reranked")])
    names = schema.names
    more = StructType([*schema.fields, *StructType.fromDDL("score double, reranked boolean").fields])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, MODEL_BATCH):
                batch = whole.slice(at, MODEL_BATCH)
                texts, scores = batch.column(text).to_pylist(), batch.column("score").to_pylist()
                done = [False] * len(texts)
                given = [i for i, t in enumerate(texts) if t is not None]
                if given:
                    results = _try(lambda part: [[x] for x in scorer(question, part)], [texts[i] for i in given])
                    for i, (value, _) in zip(given, results, strict=True):
                        if value is not None:
                            scores[i], done[i] = round(value[0], vectors.SCORE_DIGITS), True
                made = [pa.array(scores, pa.float64()), pa.array(done, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *made], [*names, "score", "reranked"])

    return hits.mapInArrow(run, more)
