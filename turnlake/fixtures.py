"""Views over the driver's tables in the shape the operators expect.

The tables carry no time, tool, model or wallet, so these are derived from the
conversation number as attributes of every row. No row is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.functions import text
from turnlake.operators import slices, turns
from turnlake.session import prepare
from turnlake.sources.tables import spread

NOW = "2024-05-01 00:00:00"
QUERY = "thing from this"
INTERNAL_MODEL_MARKER = "haiku"


def now() -> Column:
    return F.to_timestamp(F.lit(NOW))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def conversation_ts(conv_id: Column) -> Column:
    return F.timestamp_millis(
        F.unix_millis(F.to_timestamp(F.lit("2024-01-01 00:00:00")))
        + (conv_id % 120) * F.lit(86_400_000)
        + conv_id * F.lit(60_000)
    )


def conversation_attributes(conv_id: Column) -> dict[str, Column]:
    return {
        "wallet_id": conv_id % 4,
        "ts": conversation_ts(conv_id),
        "tool": F.element_at(
            F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma")), (conv_id % 3 + 1).cast("int")
        ),
        "model": F.when(conv_id % 10 == 0, F.lit(f"small-{INTERNAL_MODEL_MARKER}")).otherwise(
            F.lit("large-general")
        ),
        "incognito": conv_id % 17 == 0,
    }


def fingerprints(messages: DataFrame) -> DataFrame:
    prompts = turns.system_prompts(messages)
    return prompts.select("conv_id", text.context_fingerprint(F.col("system_text")).alias("fingerprint"))


def stored_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn pairs with identity, time, tool and context fingerprint."""
    messages = table(spark, sf_dir, "conversations")
    pairs = turns.turn_pairs(messages, keep_position=True)
    joined = slices.attach(pairs, fingerprints(messages), ["conv_id"])
    attributes = conversation_attributes(F.col("conv_id"))
    return joined.select(
        F.concat_ws("_", F.lit("turn"), "conv_id", "turn_index").alias("turn_id"),
        F.concat(F.lit("conv_"), F.col("conv_id")).alias("session_id"),
        "conv_id",
        "turn_index",
        "user_content",
        "assistant_content",
        attributes["wallet_id"].alias("wallet_id"),
        attributes["ts"].alias("ts"),
        attributes["tool"].alias("tool"),
        F.coalesce("fingerprint", F.lit(text.DEFAULT_FINGERPRINT)).alias("fingerprint"),
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture per exchange, as a client resending its history would cause."""
    from turnlake.operators import sessions

    prefixes = sessions.exchanges(table(spark, sf_dir, "conversations"))
    attributes = conversation_attributes(F.col("conv_id"))
    return prefixes.select(
        F.concat_ws("_", F.lit("cap"), "conv_id", "k").alias("capture_id"),
        "conv_id",
        "k",
        "n",
        "end_turn",
        attributes["wallet_id"].alias("wallet_id"),
        F.timestamp_millis(F.unix_millis(attributes["ts"]) + F.col("k") * 60_000).alias("ts"),
        attributes["tool"].alias("tool"),
        attributes["model"].alias("model"),
        attributes["incognito"].alias("incognito"),
    )


def provider(conv_id: Column) -> Column:
    return F.when(conv_id % 3 == 1, F.lit("anthropic")).otherwise(F.lit("openai"))


def _pick(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def memories(turns_df: DataFrame) -> DataFrame:
    """One memory per turn, holding the answer, in every state of the life cycle."""
    from turnlake.operators import memories as ops

    number = F.col("conv_id") + F.col("turn_index")
    ended = F.when(F.col("tool") == "gamma", F.timestamp_millis(F.unix_millis("ts") + F.lit(2_592_000_000)))
    return turns_df.select(
        F.concat_ws("_", F.lit("mem"), "conv_id", "turn_index").alias("memory_id"),
        "wallet_id",
        F.col("assistant_content").alias("text"),
        _pick(ops.CATEGORIES, number).alias("category"),
        _pick(ops.CONFIDENCES, number).alias("confidence"),
        F.col("session_id").alias("source"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("valid_from"),
        ended.alias("invalidated_at"),
    )


def facts(turns_df: DataFrame) -> DataFrame:
    """One fact per turn, holding the question, with a decided action.

    The target is the memory of the following turn, so the last turn of a
    conversation names one that does not exist.
    """
    from turnlake.operators import memories as ops

    number = F.col("conv_id") + F.col("turn_index")
    return turns_df.select(
        F.concat_ws("_", F.lit("fact"), "conv_id", "turn_index").alias("fact_id"),
        F.col("user_content").alias("text"),
        _pick(ops.CATEGORIES, number).alias("category"),
        _pick(ops.CONFIDENCES, number).alias("confidence"),
        F.col("session_id").alias("source"),
        F.col("ts").alias("valid_from"),
        _pick(ops.ACTIONS, number).alias("action"),
        F.concat_ws("_", F.lit("mem"), "conv_id", F.col("turn_index") + 1).alias("target_id"),
    )
