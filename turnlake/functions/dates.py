"""Time functions. "Now" is always a parameter; all calendar days are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
RECENCY_WINDOW_DAYS = 90.0
IDLE_DAYS = 7
DAY_MS = 86_400_000.0
# ----------------------------------------------------------------------------


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_iso(text: Column) -> Column:
    """NULL for an unreadable time stamp, so NaN scores never arise."""
    return F.try_to_timestamp(text)


def utc_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def age_ms(ts: Column, now: Column) -> Column:
    return F.unix_millis(now) - F.unix_millis(ts)


def recency_factor(ts: Column, now: Column) -> Column:
    """1 now, 0 from ninety days on, above 1 for future dates."""
    days = age_ms(ts, now).cast("double") / F.lit(DAY_MS)
    return F.greatest(F.lit(0.0), F.lit(1.0) - days / F.lit(RECENCY_WINDOW_DAYS))


def is_idle(last: Column, now: Column) -> Column:
    return age_ms(last, now).cast("double") / F.lit(DAY_MS) >= F.lit(float(IDLE_DAYS))


def _whole(ms: Column, unit_ms: int) -> Column:
    return F.floor(ms / F.lit(unit_ms)).cast("bigint")


def _plural(count: Column, unit: str) -> Column:
    return F.concat(count.cast("string"), F.lit(f" {unit}"), F.when(count == 1, "").otherwise("s"), F.lit(" ago"))


def relative_time_words(ts: Column, now: Column) -> Column:
    ms = age_ms(ts, now)
    minutes, hours, days = _whole(ms, 60_000), _whole(ms, 3_600_000), _whole(ms, 86_400_000)
    return (
        F.when(_whole(ms, 1000) < 60, F.lit("just now"))
        .when(minutes < 60, _plural(minutes, "minute"))
        .when(hours < 24, _plural(hours, "hour"))
        .otherwise(_plural(days, "day"))
    )


def relative_time_short(ts: Column, now: Column) -> Column:
    ms = age_ms(ts, now)
    minutes, hours, days = _whole(ms, 60_000), _whole(ms, 3_600_000), _whole(ms, 86_400_000)
    months = F.floor(days / F.lit(30)).cast("bigint")
    return (
        F.when(ts.isNull(), F.lit("never"))
        .when(minutes < 1, F.lit("just now"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .when(days < 30, F.concat(days.cast("string"), F.lit("d ago")))
        .otherwise(F.concat(months.cast("string"), F.lit("mo ago")))
    )


def date_group_label(ts: Column, now: Column) -> Column:
    days = F.datediff(F.to_date(now), F.to_date(ts))
    return (
        F.when(ts.isNull(), F.lit("Unknown"))
        .when(days == 0, F.lit("Today"))
        .when(days == 1, F.lit("Yesterday"))
        .when(days < 7, F.date_format(ts, "EEEE"))
        .when(days < 365, F.date_format(ts, "MMMM d"))
        .otherwise(F.date_format(ts, "MMMM d, yyyy"))
    )


def clock(ts: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(ts, "h:mm a"), F.lit("]"))


def hour_minute(ts: Column) -> Column:
    return F.date_format(ts, "HH'h'mm'm'")
