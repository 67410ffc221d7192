"""Sessions from overlapping captures.

Chat clients resend the whole history with every request, so one conversation
is captured many times, each time with more messages. Captures in time order
continue a session while the tool stays the same and the message count grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.operators import slices, turns

# --- fixed values -----------------------------------------------------------
INTERNAL_MAX_MESSAGES = 2
MIN_SESSION_MESSAGES = 3
# ----------------------------------------------------------------------------
MAX_PLAIN_GROUP = 1_000_000


def exchanges(messages: DataFrame) -> DataFrame:
    """One row per answered question: the prefix of the conversation up to it.

    (conv_id, k, n, end_turn) with k the number of exchanges and n the number
    of user and assistant messages so far.
    """
    spoken = turns.dialogue(messages)
    rows = spoken.drop("text")
    both = slices.with_previous(rows, turns.GROUP, turns.ORDER, ["role"])
    answers = (F.col("role") == "assistant") & F.coalesce(F.col("prev_role") == "user", F.lit(False))
    flagged = both.withColumn("_answer", answers.cast("int"))
    counted = slices.with_running_sum(flagged, turns.GROUP, turns.ORDER, F.lit(1), "n")
    numbered = slices.with_running_sum(counted, turns.GROUP, turns.ORDER, F.col("_answer"), "k")
    return numbered.filter("_answer = 1").select("conv_id", "k", "n", F.col("turn").alias("end_turn"))


def usable(captures: DataFrame, marker: str) -> DataFrame:
    """Without incognito captures and internal tool calls; what is not said is neither."""
    internal = F.col("model").contains(marker) & (F.col("n") <= INTERNAL_MAX_MESSAGES)
    hidden = F.coalesce("incognito", F.lit(False)) | F.coalesce(internal, F.lit(False))
    return captures.filter(~hidden)


def assign_sessions(captures: DataFrame, marker: str, group: str = "wallet_id") -> DataFrame:
    """Add ``session_no``, counted from 1 per wallet in (ts, capture_id) order."""
    rows = usable(captures, marker)
    order = ["ts", "capture_id"]
    sliced = slices.cut_large_groups(rows, [group], order, MAX_PLAIN_GROUP)
    before = slices.with_previous(sliced, [group], order, ["tool", "n"])
    continues = (F.col("tool") == F.col("prev_tool")) & (F.col("n") > F.col("prev_n"))
    starts = F.when(F.coalesce(continues, F.lit(False)), 0).otherwise(1)
    numbered = slices.with_running_sum(before.withColumn("_start", starts), [group], order, F.col("_start"), "session_no")
    return numbered.select(*rows.columns, "session_no")


def representatives(sessions: DataFrame, group: str = "wallet_id") -> DataFrame:
    """Last capture of each session, if it has at least three messages.

    An aggregate rather than a ranking window: map-side combining keeps a
    session of any length to one row per input partition.
    """
    rest = [c for c in sessions.columns if c not in (group, "session_no", "ts", "capture_id")]
    last = F.max(F.struct("ts", "capture_id", *rest)).alias("last")
    return (
        sessions.groupBy(group, "session_no")
        .agg(last)
        .select(group, "session_no", "last.*")
        .filter(F.col("n") >= MIN_SESSION_MESSAGES)
    )


def pending(sessions: DataFrame, processed: DataFrame, key: str = "capture_id") -> DataFrame:
    """Representatives not processed yet."""
    return sessions.join(processed.select(key).distinct(), key, "left_anti")

