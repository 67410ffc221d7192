"""Turn pairs: a user message directly followed by an assistant message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.functions.redaction import redact_secrets
from turnlake.operators import slices

GROUP = ["conv_id"]
ORDER = ["turn"]


def dialogue(messages: DataFrame) -> DataFrame:
    """Messages without system rows, sliced where conversations are very long."""
    return slices.cut(messages, "turn").filter(F.col("role") != "system")


def _slice_column(rows: DataFrame) -> list[str]:
    return [slices.SLICE] if slices.is_sliced(rows) else []


def turn_pairs(messages: DataFrame, redact: bool = True, keep_position: bool = False) -> DataFrame:
    """(conv_id, turn_index, user_content, assistant_content), numbered from 0.

    Input: ``conv_id, turn, role, text`` with (conv_id, turn) unique. With
    ``keep_position`` the user message's ``turn`` (and slice) stay.
    """
    spoken = dialogue(messages)
    rows = spoken.select("conv_id", "turn", *_slice_column(spoken), "role", "text")
    answered = slices.with_next(rows, GROUP, ORDER, ["role", "text"]).filter(
        (F.col("role") == "user") & (F.col("next_role") == "assistant")
    )
    numbered = slices.with_row_number(answered, GROUP, ORDER, "_number")
    clean = redact_secrets if redact else (lambda column: column)
    return numbered.select(
        "conv_id",
        (F.col("_number") - 1).alias("turn_index"),
        clean(F.col("text")).alias("user_content"),
        clean(F.col("next_text")).alias("assistant_content"),
        *(["turn", *_slice_column(spoken)] if keep_position else []),
    )


def orphan_messages(messages: DataFrame) -> DataFrame:
    """Dialogue rows that belong to no turn pair."""
    spoken = dialogue(messages)
    rows = spoken.select("conv_id", "turn", *_slice_column(spoken), "role")
    both = slices.with_previous(slices.with_next(rows, GROUP, ORDER, ["role"]), GROUP, ORDER, ["role"])
    asked = (F.col("role") == "user") & F.coalesce(F.col("next_role") == "assistant", F.lit(False))
    answered = (F.col("role") == "assistant") & F.coalesce(F.col("prev_role") == "user", F.lit(False))
    return both.filter(~asked & ~answered).select("conv_id", "turn", "role")


def last_message(messages: DataFrame, role: str = "user") -> DataFrame:
    """Last message of a role per conversation; combined on the map side."""
    return (
        messages.filter(F.col("role") == role)
        .groupBy("conv_id")
        .agg(F.max_by("text", "turn").alias("content"))
    )


def system_prompts(messages: DataFrame) -> DataFrame:
    """First system message per conversation."""
    return (
        messages.filter(F.col("role") == "system")
        .groupBy("conv_id")
        .agg(F.min_by("text", "turn").alias("system_text"))
    )


def capture_records(messages: DataFrame) -> DataFrame:
    """(conv_id, part, first_index, messages): dialogue rows as message arrays.

    An ordinary conversation is one record. A very long one is one record per
    slice; each repeats the message before the slice, so that a pair across the
    border is found exactly once, and ``first_index`` numbers pairs on.
    """
    spoken = dialogue(messages)
    before = slices.with_previous(spoken, GROUP, ORDER, ["role", "text"])
    answer = ((F.col("role") == "assistant") & F.coalesce(F.col("prev_role") == "user", F.lit(False))).cast("int")
    flagged = before.withColumn("_answer", answer)
    counted = slices.with_running_sum(flagged, GROUP, ORDER, F.col("_answer"), "_k")
    key = ["conv_id", *_slice_column(spoken)]
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    records = counted.groupBy(*key).agg(
        F.transform(listed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("own"),
        F.min_by(F.struct(F.col("prev_role").alias("role"), F.col("prev_text").alias("content")), "turn").alias("head"),
        F.min_by(F.col("_k") - F.col("_answer"), "turn").alias("first_index"),
    )
    part = F.col(slices.SLICE) if slices.is_sliced(spoken) else F.lit(0).cast("bigint")
    joined = F.when(F.col("head.role").isNull(), F.col("own")).otherwise(F.concat(F.array("head"), F.col("own")))
    return records.select("conv_id", part.alias("part"), "first_index", joined.alias("messages"))


def pairs_in_array(messages):
    """The same pairing inside one captured request, as an array expression.

    ``messages`` is ``array<struct<role, content>>``; the result is an array of
    ``struct<turn_index, user_content, assistant_content>``.
    """
    spoken = F.filter(messages, lambda m: m["role"] != F.lit("system"))
    count = F.size(spoken)
    couples = F.filter(
        F.transform(
            F.when(count > 1, F.sequence(F.lit(0), count - 2)).otherwise(F.array().cast("array<int>")),
            lambda i: F.struct(F.get(spoken, i).alias("a"), F.get(spoken, i + 1).alias("b")),
        ),
        lambda c: (c["a"]["role"] == F.lit("user")) & (c["b"]["role"] == F.lit("assistant")),
    )
    return F.transform(
        couples,
        lambda c, i: F.struct(
            i.cast("bigint").alias("turn_index"),
            redact_secrets(c["a"]["content"]).alias("user_content"),
            redact_secrets(c["b"]["content"]).alias("assistant_content"),
        ),
    )
