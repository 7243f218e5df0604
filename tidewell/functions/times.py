"""Time buckets, look-back windows, lags and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .casts import like_time, ts

MAX_LOOKBACK_DAYS = 3650

# Schedule names and their minutes; ``manual`` has no next run.
SCHEDULE_MINUTES = {
    "every_15m": 15,
    "every_hour": 60,
    "every_6h": 360,
    "daily": 1440,
    "weekly": 10080,
    "manual": None,
    "every_15min": 15,
    "every_30min": 30,
    "every_3h": 180,
    "every_12h": 720,
    "every_day": 1440,
    "every_week": 10080,
}


def bucket(time: Column, grain: str) -> Column:
    """First day of the day/week/month/quarter/year; weeks start on Sunday."""
    day = F.to_date(time)
    grain = grain.lower()
    if grain == "day":
        return day
    if grain == "week":
        return F.date_sub(day, F.dayofweek(day) - 1)
    if grain in ("month", "quarter", "year"):
        return F.trunc(day, grain)
    raise ValueError(f"unknown bucket {grain!r}")


def days(n: int) -> Column:
    return F.make_dt_interval(F.lit(int(n)))


def clamp_days(n: int, high: int = MAX_LOOKBACK_DAYS) -> int:
    return min(max(int(n), 1), high)


def within(df: DataFrame, name: str, as_of, n_days: int) -> Column:
    """Rows of the last ``n_days`` before ``as_of``; the upper end is open."""
    return ts(df, name) >= like_time(df, name, as_of) - days(clamp_days(n_days))


def lag_hours(start: Column, as_of: Column) -> Column:
    """Whole hours between two times, truncated."""
    return F.timestamp_diff("HOUR", start, as_of)


def epoch_ms(c: Column) -> Column:
    return F.timestamp_millis(c.cast("long"))


def next_run(schedule: Column, start: Column) -> Column:
    """Next due time for a schedule name; manual and unknown names give NULL."""
    minutes = F.lit(None).cast("int")
    for name, value in SCHEDULE_MINUTES.items():
        if value is not None:
            minutes = F.when(schedule == name, F.lit(value)).otherwise(minutes)
    return start + F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def month_first(text: Column) -> Column:
    """``YYYY-MM-DD`` text as ``MM-DD-YYYY``; other text is returned unchanged."""
    iso = r"^(\d{4})-(\d{2})-(\d{2})$"
    return F.when(text.rlike(iso), F.regexp_replace(text, iso, "$2-$3-$1")).otherwise(text)
