"""Score boosts and near-duplicate removal on a fetched result list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions import text as tx
from turnlake.functions.dates import recency_factor
from turnlake.operators.bm25 import SCORE_DIGITS

# --- fixed values -----------------------------------------------------------
CONTEXT_BOOST = 1.5
OVERLAP_THRESHOLD = 0.9
# ----------------------------------------------------------------------------


def context_multiplier(fingerprint: Column, wanted: Column) -> Column:
    """1.5 for turns of the asking project; never for the default context."""
    same = wanted.isNotNull() & (wanted != tx.DEFAULT_FINGERPRINT) & (fingerprint == wanted)
    return F.when(same, F.lit(CONTEXT_BOOST)).otherwise(F.lit(1.0))


def boosted(score: Column, ts: Column, now: Column, boost: float, fingerprint: Column, wanted: Column) -> Column:
    recency = F.lit(1.0) + F.lit(float(boost)) * recency_factor(ts, now)
    return score * recency * context_multiplier(fingerprint, wanted)


def drop_near_duplicates(
    hits: DataFrame, text: Column, key: str, session: Sequence[str] = ("session_id",), score: str = "score"
) -> DataFrame:
    """Keep a hit unless a better kept hit of its session shares over 90 % of words.

    Greedy by descending score: a dropped hit drops nothing itself. ``hits`` is
    a fetched list of at most twice the result limit per query, so the arrays
    folded here are bounded by that limit.
    """
    entry = F.struct(
        (-F.col(score)).alias("order"),
        F.col(key).alias("key"),
        tx.word_set(text).alias("words"),
        F.struct(*hits.columns).alias("hit"),
    )
    listed = hits.groupBy(*session).agg(F.sort_array(F.collect_list(entry)).alias("_listed"))

    def near(candidate):
        return lambda kept: tx.word_set_overlap(kept["words"], candidate["words"]) > F.lit(OVERLAP_THRESHOLD)

    kept = F.aggregate(
        F.col("_listed"),
        F.slice(F.col("_listed"), 1, 0),
        lambda acc, x: F.when(F.exists(acc, near(x)), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return listed.select(F.inline(F.transform(kept, lambda x: x["hit"])))


def ranked(hits: DataFrame, key: str, limit: int, min_score: float, score: str = "score") -> DataFrame:
    """Threshold, then the best ``limit`` rows."""
    return hits.filter(F.col(score) >= F.lit(float(min_score))).orderBy(F.desc(score), F.asc(key)).limit(limit)


def rounded(score: Column) -> Column:
    return F.round(score, SCORE_DIGITS)
