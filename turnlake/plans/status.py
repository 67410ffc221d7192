"""Usage figures over stored turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions import dates
from turnlake.functions import text as tx


def status(turns: DataFrame) -> DataFrame:
    """One row: turns, sessions, tools, last capture."""
    return turns.agg(
        F.count(F.lit(1)).alias("turn_count"),
        F.countDistinct("session_id").alias("session_count"),
        F.countDistinct("tool").alias("tool_count"),
        dates.iso_utc(F.max("ts")).alias("last_capture_at"),
    )


def date_groups(turns: DataFrame, now: Column) -> DataFrame:
    """(label, n_turns, latest): turns per heading, combined on the map side."""
    return (
        turns.groupBy(dates.date_group_label(F.col("ts"), now).alias("label"))
        .agg(F.count(F.lit(1)).alias("n_turns"), dates.iso_utc(F.max("ts")).alias("latest"))
    )


def filter_turns(turns: DataFrame, needle: str) -> DataFrame:
    return turns.filter(
        tx.matches_any(needle, F.col("user_content"), F.col("assistant_content"), F.col("tool"))
    )
