"""Token-budgeted context block from ranked turns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.config import InjectionConfig
from turnlake.functions import dates
from turnlake.functions import text as tx

# --- fixed values -----------------------------------------------------------
PROFILE_HEADER = "## About You"
TURNS_HEADER = "## Relevant Past Conversations"
SEPARATOR = "\n\n"
# ----------------------------------------------------------------------------


def turn_entries(hits: DataFrame) -> DataFrame:
    """Add ``entry``, the text a turn contributes."""
    day = dates.utc_day(F.col("ts"))
    return hits.withColumn("entry", tx.format_turn_entry(F.col("user_content"), F.col("assistant_content"), day))


def skeleton(profile: str, context_tag: str = tx.CONTEXT_TAG) -> str:
    """The block without entries."""
    trimmed = profile.strip(tx.WHITESPACE)
    about = [f"{PROFILE_HEADER}\n{trimmed}"] if trimmed else []
    return SEPARATOR.join([f"<{context_tag}>", *about, TURNS_HEADER, f"</{context_tag}>"])


def pack(
    entries: DataFrame,
    profile: str = "",
    config: InjectionConfig = InjectionConfig(),
    query: Sequence[str] = (),
    context_tag: str = tx.CONTEXT_TAG,
) -> DataFrame:
    """Entries that fit: a prefix by rank within the token budget and turn limit.

    Costs are never negative, so stopping at the first entry that does not fit
    is the same as a bound on the running cost. ``entries`` holds a fetched
    result list (at most the search limit) per query key.
    """
    by_query = list(query)
    key = [F.col(c) for c in by_query] or [F.lit(0)]
    order = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc("turn_id"))
    with_gap = F.when(F.col("position") > 1, F.concat(F.lit(SEPARATOR), F.col("entry"))).otherwise(F.col("entry"))
    budget = F.greatest(
        F.lit(0).cast("bigint"),
        F.lit(config.max_tokens) - tx.estimate_tokens(F.lit(skeleton(profile, context_tag))),
    )
    return (
        entries.withColumn("position", F.row_number().over(order).cast("bigint"))
        .withColumn("cost", tx.estimate_tokens(with_gap))
        .withColumn(
            "running_cost",
            F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("bigint"),
        )
        .filter((F.col("position") <= config.max_turns) & (F.col("running_cost") <= budget))
    )


def injection_block(
    entries: DataFrame,
    profile: str = "",
    config: InjectionConfig = InjectionConfig(),
    context_tag: str = tx.CONTEXT_TAG,
) -> DataFrame:
    """One row: text, token_count, memory_count, has_profile."""
    trimmed = profile.strip(tx.WHITESPACE)
    packed = pack(entries, profile, config, context_tag=context_tag)
    listed = F.array_sort(F.collect_list(F.struct("position", "entry")))
    # The number of hits decides between an empty block and one without entries.
    gathered = packed.agg(
        F.array_join(F.transform(listed, lambda e: e["entry"]), SEPARATOR).alias("body"),
        F.count(F.lit(1)).alias("memory_count"),
    ).withColumn("n_hits", entries.agg(F.count(F.lit(1))).scalar())
    head = [F.lit(f"<{context_tag}>")] + ([F.lit(f"{PROFILE_HEADER}\n{trimmed}")] if trimmed else [])
    turns_part = F.when(
        F.col("memory_count") > 0, F.concat(F.lit(f"{TURNS_HEADER}\n"), F.col("body"))
    ).otherwise(F.lit(TURNS_HEADER))
    full = F.concat_ws(SEPARATOR, *head, turns_part, F.lit(f"</{context_tag}>"))
    empty = F.lit(not trimmed) & (F.col("n_hits") == 0)
    return gathered.withColumn("text", F.when(empty, F.lit("")).otherwise(full)).select(
        "text",
        tx.estimate_tokens(F.col("text")).alias("token_count"),
        "memory_count",
        F.lit(bool(trimmed)).alias("has_profile"),
    )


def into_system_prompt(original: Column, block: Column) -> Column:
    """Block, blank line, original prompt; either alone where the other is empty."""
    nothing = F.lit("")
    return (
        F.when(F.coalesce(block, nothing) == nothing, F.coalesce(original, nothing))
        .when(F.coalesce(original, nothing) == nothing, block)
        .otherwise(F.concat_ws(SEPARATOR, block, original))
    )
