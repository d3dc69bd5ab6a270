"""Time functions; ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def millis_between(start: Column, end: Column) -> Column:
    return F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000)


def relative_date(ts: Column, now: Column) -> Column:
    """Age in words; older than a week as an ISO date. A future time is "Just now"."""
    ms = millis_between(ts, now)
    ago = lambda unit, letter: F.concat(F.floor(ms / unit).cast("string"), F.lit(f"{letter} ago"))
    return (
        F.when(ms < 60_000, "Just now")
        .when(ms < 3_600_000, ago(60_000, "m"))
        .when(ms < 86_400_000, ago(3_600_000, "h"))
        .when(ms < 604_800_000, ago(86_400_000, "d"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )


def expires_at(now: Column, days: int = 7) -> Column:
    """Whole days of 24 hours."""
    return now + F.make_dt_interval(F.lit(days))


def minutes(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), n)


def elapsed_seconds(start: Column, end: Column) -> Column:
    """To one decimal, halves up."""
    return F.round(millis_between(start, end) / 1000, 1)


def cooled_down(dismissed: Column, now: Column, days: int = 7) -> Column:
    """Shown if never dismissed, or strictly longer ago than the cooldown."""
    return dismissed.isNull() | (millis_between(dismissed, now) > days * 86_400_000)


def progress_status(ms: Column) -> Column:
    """What a waiting screen says after so many milliseconds; null before anything."""
    return (
        F.when(ms >= 120_000, "Analysis is taking too long. Please try again.")
        .when(ms >= 25_000, "Almost there...")
        .when(ms >= 15_000, "Still analyzing — complex ingredients take longer...")
        .when(ms >= 8_000, "Reading ingredients...")
    )


def timed_out(status: Column, start: Column, end: Column, limit_ms: int = 120_000) -> Column:
    """Only what still runs can time out."""
    return F.when((status == "running") & (millis_between(start, end) >= limit_ms), "error").otherwise(status)
