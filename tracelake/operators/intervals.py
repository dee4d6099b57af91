"""Gaps and islands over days and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged_days(days: DataFrame, keys: list[str], day: str = "day", count: str = "n", gap: int = 0) -> DataFrame:
    """Days per key, at most `gap` empty days apart, as ranges: start_day,
    end_day, days (from start to end), n. One row per key and day is expected."""
    w = Window.partitionBy(*keys).orderBy(day)
    starts = (F.datediff(F.col(day), F.lag(day).over(w)) > gap + 1) | F.lag(day).over(w).isNull()
    return (
        days.withColumn("_island", F.sum(starts.cast("int")).over(w))
        .groupBy(*keys, "_island").agg(F.min(day).alias("start_day"), F.max(day).alias("end_day"), F.sum(count).alias("n"))
        .withColumn("days", (F.datediff("end_day", "start_day") + 1).cast("long")).drop("_island")
    )


def merged_spans(spans: DataFrame, keys: list[str], start: str = "start_day", end: str = "end_day") -> DataFrame:
    """Overlapping or touching half-open spans per key as one. Null bounds and
    empty spans take no part."""
    w = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    usable = spans.where(F.col(start) < F.col(end)).select(*keys, start, end)
    reach = F.max(end).over(w)
    w_id = Window.partitionBy(*keys).orderBy(start, end)
    return (
        usable.withColumn("_new", (reach.isNull() | (F.col(start) > reach)).cast("int"))
        .withColumn("_island", F.sum("_new").over(w_id))
        .groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
    )


def clipped(spans: DataFrame, low: str, high: str, start: str = "start_day", end: str = "end_day") -> DataFrame:
    """Spans cut to a window of days; those outside it go."""
    a, b = F.lit(low).cast("date"), F.lit(high).cast("date")
    return spans.where((F.col(start) <= b) & (F.col(end) >= a)).withColumns({start: F.greatest(F.col(start), a), end: F.least(F.col(end), b)})


def dense_days(counts: DataFrame, keys: list[str], first: str, last: str, day: str = "day", count: str = "n") -> DataFrame:
    """A row for every day of each key from first to last, 0 where there is none."""
    every = counts.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(day))
    return every.join(counts, [*keys, day], "left").withColumn(count, F.coalesce(count, F.lit(0)))


def streaks(days: DataFrame, keys: list[str], today: str, day: str = "day") -> DataFrame:
    """Length of the run of days that ends today, or yesterday if today is still
    open; 0 without one. One row per key and day is expected."""
    runs = merged_days(days.withColumn("_one", F.lit(1)), keys, day, "_one")
    at = F.lit(today).cast("date")
    live = F.col("end_day").isin(F.lit(today).cast("date")) | (F.col("end_day") == F.date_sub(at, 1))
    return runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(live, F.col("days"))), F.lit(0)).cast("long").alias("streak"))
