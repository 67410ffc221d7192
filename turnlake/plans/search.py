"""Turn search and collection search, composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.config import InjectionConfig
from turnlake.operators import bm25, passages, rerank, vectors
from turnlake.session import cut_lineage
from turnlake.sources import bodies

DEFAULTS = InjectionConfig()


def turn_text() -> Column:
    """What is indexed of a turn: question, newline, answer."""
    return F.concat_ws("\n", "user_content", "assistant_content")


def compared_text() -> Column:
    return F.concat_ws(" ", "user_content", "assistant_content")


def between(after: Column | None = None, before: Column | None = None) -> Column | None:
    """Condition after <= ts < before; None without a limit."""
    parts = [F.col("ts") >= after] * (after is not None) + [F.col("ts") < before] * (before is not None)
    return None if not parts else parts[0] if len(parts) == 1 else parts[0] & parts[1]


def in_date_range(turns: DataFrame, after: Column | None = None, before: Column | None = None) -> DataFrame:
    """after <= ts < before. Where turns are stored by day, the days outside are never read."""
    limits = between(after, before)
    if limits is None:
        return turns
    if "turn_date" in turns.columns:
        if after is not None:
            turns = turns.filter(F.col("turn_date") >= F.to_date(after))
        if before is not None:
            turns = turns.filter(F.col("turn_date") <= F.to_date(before))
    return turns.filter(limits)


def rerank_turns(
    fetched: DataFrame,
    now: Column,
    limit: int = DEFAULTS.max_turns,
    min_score: float = DEFAULTS.min_relevance_score,
    recency_boost: float = DEFAULTS.recency_boost,
    fingerprint: Column | None = None,
) -> DataFrame:
    """Boost, remove near duplicates, cut by score and limit, number from 1."""
    wanted = F.lit(None).cast("string") if fingerprint is None else fingerprint
    final = rerank.boosted(
        F.col("score"), F.col("ts"), now, recency_boost, F.col("fingerprint"), F.col("_wanted")
    )
    boosted = (
        fetched.filter(F.col("ts").isNotNull())
        .withColumn("_wanted", wanted)
        .withColumn("score", rerank.rounded(final))
        .drop("_wanted")
    )
    distinct = rerank.drop_near_duplicates(boosted, compared_text(), "turn_id")
    best = rerank.ranked(distinct, "turn_id", limit, min_score)
    # At most ``limit`` rows reach this window.
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), F.asc("turn_id"))
    return best.withColumn("rank", F.row_number().over(order).cast("bigint"))


def fetch_turns(turns: DataFrame, query: str, limit: int) -> DataFrame:
    """Twice the wanted number of turns by BM25."""
    return bm25.search(turns, turn_text(), query, "turn_id", 2 * limit)


def search_turns(
    turns: DataFrame,
    query: str,
    now: Column,
    limit: int = DEFAULTS.max_turns,
    min_score: float = DEFAULTS.min_relevance_score,
    recency_boost: float = DEFAULTS.recency_boost,
    fingerprint: Column | None = None,
) -> DataFrame:
    fetched = fetch_turns(turns, query, limit)
    return rerank_turns(fetched, now, limit, min_score, recency_boost, fingerprint)


def fetch_turns_hybrid(
    turns: DataFrame, vectors_df: DataFrame | None, query: str, query_vector: Sequence[float], limit: int
) -> DataFrame:
    """Twice the wanted number of turns by fused lexical and vector rank.

    Without vectors (None) the lexical list is used alone; whether there are any
    is known when the plan is built.
    """
    lexical = fetch_turns(turns, query, limit)
    if vectors_df is None:
        return lexical
    # A list of numbers is one literal; at most 2 * limit keys are broadcast.
    near = vectors.nearest(vectors_df, "turn_id", "embedding", F.lit(list(query_vector)), 2 * limit)
    fused = vectors.fuse([lexical.select("turn_id", "score"), near], "turn_id", 2 * limit, depth=2 * limit, unit=True)
    return turns.join(F.broadcast(fused), "turn_id")


def search_collections(
    collections: dict[str, DataFrame], query: str, limit: int = 10, min_score: float = 0.3
) -> DataFrame:
    """Search several collections of (id, _dl, term counts); statistics are per collection.

    Each value comes from ``bm25.count_terms`` / ``bm25.merge_counts`` with a
    column ``id``. Result: source, id, score.
    """
    from turnlake.functions.text import query_terms

    terms = query_terms(query)
    parts = []
    for source, counted in collections.items():
        scored = bm25.score_counted(counted, terms).select(F.lit(source).alias("source"), "id", "score")
        top = scored.orderBy(F.desc("score"), F.asc("id")).limit(2 * limit)
        parts.append(top.filter(F.col("score") >= F.lit(float(min_score))))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.orderBy(F.desc("score"), F.asc("source"), F.asc("id")).limit(limit)


def search_passages(
    docs: DataFrame,
    key: str,
    body: Column,
    embedded: DataFrame,
    query: str,
    query_vector: Sequence[float],
    limit: int = 10,
    scorer: passages.Scorer | None = None,
    size: int = passages.SIZE,
) -> DataFrame:
    """(key, score, best_chunk, best_chunk_pos): hybrid search whose vector side looks at passages.

    Twice the limit by BM25 and by nearest passage are fused; with a ``scorer``
    the fused hits are ordered anew by what it gives to their best passage.
    """
    vector, wide = F.lit(list(query_vector)), 2 * limit
    lexical = bm25.search(docs, body, query, key, wide).select(key, "score")
    near = passages.nearest(embedded, key, vector, wide).select(key, "score")
    fused = vectors.fuse([lexical, near], key, wide if scorer else limit, depth=wide, unit=True)
    placed = passages.with_best(cut_lineage(fused), embedded, key, vector)
    # At most twice the limit, so texts are read for these documents only.
    texts = docs.select(key, body.alias("_body")).join(F.broadcast(placed), key)
    start = F.coalesce("best_start", F.lit(0).cast("bigint"))
    hits = texts.select(
        key, "score", F.substring("_body", (start + 1).cast("int"), F.lit(size)).alias("best_chunk"), start.alias("best_chunk_pos")
    )
    order = [F.desc("score"), F.asc(key)]
    if scorer is not None:
        hits, order = passages.rerank(hits, query, "best_chunk", scorer), [F.desc("reranked"), *order]
    return hits.orderBy(*order).limit(limit).select(key, "score", "best_chunk", "best_chunk_pos")


def results(hits: DataFrame, index: DataFrame, store: str, context: Column | None = None) -> DataFrame:
    """Hits (collection, path, score, more columns) in the shape users see, with bodies fetched last.

    ``index`` describes the stored documents: collection, path, title, hash,
    modified_at. Hits whose document is gone drop out.
    """
    own = [c for c in hits.columns if c not in ("collection", "path", "score")]
    described = index.select("collection", "path", "title", "hash", "modified_at")
    named = described.join(F.broadcast(hits), ["collection", "path"]).select(
        F.concat_ws("/", "collection", "path").alias("file"),
        F.col("path").alias("display_path"),
        "title",
        F.col("collection").alias("collection_name"),
        (F.lit(None).cast("string") if context is None else context).alias("context"),
        "hash",
        F.substring("hash", 1, 6).alias("docid"),
        "modified_at",
        "score",
        *own,
    )
    return bodies.attach(named, store).withColumn("body_length", F.length("body").cast("bigint"))
