"""Extracted facts as a versioned table (valid_from, nullable invalidated_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions import text as tx
from turnlake.functions.requests import array_at, at, kind, string_at
from turnlake.operators import slices

# --- fixed values -----------------------------------------------------------
CATEGORIES = ("IDENTITY", "PREFERENCE", "CONTEXT", "RELATIONSHIP", "SKILL", "EVENT")
CONFIDENCES = ("HIGH", "MEDIUM", "LOW")
ACTIONS = ("ADD", "UPDATE", "INVALIDATE", "NOOP")
DEFAULT_NOOP_REASON = "Already captured"
# ----------------------------------------------------------------------------

MEMORY_COLUMNS = (
    "memory_id", "text", "category", "confidence", "source", "created_at", "valid_from", "invalidated_at",
)


def _as_text(value: Column, path: str) -> Column:
    """A JSON scalar as text, '' when absent or null."""
    found = at(value, path)
    return F.when(kind(found).isNull() | (kind(found) == "VOID"), F.lit("")).otherwise(
        F.coalesce(F.try_variant_get(value, path, "string"), F.lit(""))
    )


def parse_facts(responses: DataFrame, content: str = "content") -> DataFrame:
    """One row per valid fact of a model answer, in order.

    Adds ``fact_no`` (from 0), ``text``, ``category``, ``confidence`` and
    ``summary_update``; unparseable answers give no rows (see ``facts_error``).
    """
    parsed = responses.withColumn("_json", F.try_parse_json(tx.strip_code_fence(F.col(content))))
    facts = F.transform(
        array_at(F.col("_json"), "$.facts"),
        lambda fact: F.struct(
            tx.js_trim(_as_text(fact, "$.text")).alias("text"),
            _as_text(fact, "$.category").alias("category"),
            _as_text(fact, "$.confidence").alias("confidence"),
        ),
    )
    valid = F.filter(
        facts,
        lambda f: (f["text"] != F.lit("")) & f["category"].isin(*CATEGORIES) & f["confidence"].isin(*CONFIDENCES),
    )
    return parsed.select(
        *responses.columns,
        tx.js_trim(_as_text(F.col("_json"), "$.summary_update")).alias("summary_update"),
        F.posexplode(valid).alias("fact_no", "_fact"),
    ).select(
        *responses.columns, F.col("fact_no").cast("bigint").alias("fact_no"), "_fact.*", "summary_update"
    )


def facts_error(content: Column) -> Column:
    """Why an answer holds no facts; NULL for a usable one."""
    parsed = F.try_parse_json(tx.strip_code_fence(content))
    return F.when(parsed.isNull(), F.lit("not JSON")).when(
        array_at(parsed, "$.facts").isNull(), F.lit("facts array missing")
    )


def parse_decision(content: Column) -> Column:
    """Struct (action, target_id, reason); anything unusable becomes ADD."""

    def decide(parsed: Column) -> Column:
        action = string_at(parsed, "$.action")
        target = F.nullif(_as_text(parsed, "$.targetId"), F.lit(""))
        reason = F.nullif(_as_text(parsed, "$.reason"), F.lit(""))
        needs_target = action.isin("UPDATE", "INVALIDATE")
        usable = F.coalesce(action.isin(*ACTIONS) & (~needs_target | target.isNotNull()), F.lit(False))
        return F.struct(
            F.when(usable, action).otherwise("ADD").alias("action"),
            F.when(usable & needs_target, target).alias("target_id"),
            F.when(usable & (action == "NOOP"), F.coalesce(reason, F.lit(DEFAULT_NOOP_REASON))).alias("reason"),
        )

    return tx.bind(F.try_parse_json(tx.strip_code_fence(content)), decide)


def resolve_actions(actions: DataFrame, memories: DataFrame) -> DataFrame:
    """Add ``applied``: false for UPDATE/INVALIDATE of an unknown memory.

    Targets are reduced to distinct ids before meeting the memory table, and
    only actions that name a target are matched with the found ids.
    """
    targeted = F.col("action").isin("UPDATE", "INVALIDATE")
    asked = actions.filter(targeted).select(F.col("target_id").alias("memory_id")).distinct()
    known = memories.join(asked, "memory_id", "left_semi").select(
        F.col("memory_id").alias("target_id"), F.lit(True).alias("_known")
    )
    # Actions without a target stay out of the join; their NULL keys would
    # otherwise all meet in one partition.
    matched = (
        actions.filter(targeted)
        .join(known, "target_id", "left")
        .select(*actions.columns, F.coalesce(F.col("_known"), F.lit(False)).alias("applied"))
    )
    return matched.unionByName(actions.filter(~targeted).withColumn("applied", F.lit(True)))


def apply_actions(memories: DataFrame, resolved: DataFrame, now: Column) -> DataFrame:
    """Next snapshot of the memory table.

    ``resolved`` carries per action: fact_id, text, category, confidence,
    source, valid_from, action, target_id, applied. A target that has already
    ended keeps its end.
    """
    # Targets that do not exist find no row to end, so ``applied`` is not needed
    # here and the look-up behind it is not run for this branch.
    ended = (
        resolved.filter(F.col("action").isin("UPDATE", "INVALIDATE"))
        .select(F.col("target_id").alias("memory_id"))
        .distinct()
        .withColumn("_ended", F.lit(True))
    )
    kept = memories.join(ended, "memory_id", "left").withColumn(
        "invalidated_at", F.when(F.col("_ended"), F.coalesce("invalidated_at", now)).otherwise(F.col("invalidated_at"))
    )
    added = resolved.filter(F.col("applied") & F.col("action").isin("ADD", "UPDATE")).select(
        tx.derived_id("mem", F.col("fact_id")).alias("memory_id"),
        "text",
        "category",
        "confidence",
        "source",
        now.alias("created_at"),
        "valid_from",
        F.lit(None).cast("timestamp").alias("invalidated_at"),
    )
    return kept.select(*MEMORY_COLUMNS).unionByName(added)


def action_counts(resolved: DataFrame) -> DataFrame:
    """One row of counters."""
    done = F.col("applied")
    return resolved.agg(
        F.count_if((F.col("action") == "ADD") & done).alias("created"),
        F.count_if((F.col("action") == "UPDATE") & done).alias("updated"),
        F.count_if((F.col("action") == "INVALIDATE") & done).alias("invalidated"),
        F.count_if((F.col("action") == "NOOP") & done).alias("noop"),
        F.count_if(~done).alias("skipped"),
    )


def live_high(memories: DataFrame) -> DataFrame:
    """High-confidence memories still valid, with a text."""
    return memories.filter(
        (F.col("confidence") == "HIGH") & F.col("invalidated_at").isNull() & (tx.js_trim(F.col("text")) != "")
    )


def profile_lines(memories: DataFrame, group: str = "wallet_id", limit: int = 1_000_000) -> DataFrame:
    """Numbered lines ``n. text`` per wallet in (created_at, memory_id) order.

    Numbering runs on keys only; texts are joined back by id.
    """
    live = live_high(memories)
    order = ["created_at", "memory_id"]
    keys = slices.cut_large_groups(live.select(group, *order), [group], order, limit)
    numbered = slices.with_row_number(keys, [group], order, "n").select("memory_id", "n")
    return live.join(numbered, "memory_id").select(
        group, "n", F.concat(F.col("n"), F.lit(". "), tx.js_trim(F.col("text"))).alias("line")
    )
