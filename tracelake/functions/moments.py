"""Time: local calendars, granularity, durations, windows of dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Bogota"


def local_time(ts: Column, zone: str = ZONE) -> Column:
    """A UTC instant on the wall clock of a zone."""
    return F.from_utc_timestamp(ts.cast("timestamp"), zone)


def local_day(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(local_time(ts, zone))


def half_open(ts: Column, since: str | None = None, until: str | None = None) -> Column:
    """since <= ts < until; a missing bound is no bound."""
    out = F.lit(True)
    if since is not None:
        out = out & (ts >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        out = out & (ts < F.lit(until).cast("timestamp_ntz"))
    return out


def granularity(hours: float | None) -> str:
    """Buckets of a histogram: minutes up to two hours, days beyond four days, else hours."""
    if hours is None:
        return "hour"
    return "minute" if hours <= 2 else "hour" if hours <= 96 else "day"


def duration_seconds(iso: Column) -> Column:
    """PnDTnHnMnS in seconds; null if it is no such duration."""
    part = lambda unit, s: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(iso, f"([0-9]+){unit}", 1), F.lit("")), F.lit("999999999")), F.lit(0)).cast("long") * s
    return F.when(iso.rlike("^P(?=[0-9T])([0-9]+D)?(T(?=[0-9])([0-9]+H)?([0-9]+M)?([0-9]+S)?)?$"), part("D", 86400) + part("H", 3600) + part("M", 60) + part("S", 1))


def backoff_seconds(failures: Column, first: int = 60, most: int = 3600) -> Column:
    """Doubling with each failure, up to an hour."""
    return F.least(first * F.pow(F.lit(2), F.least(failures, F.lit(6))), F.lit(most)).cast("long")
