"""Roll-ups of telemetry: costs, counts, histograms, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import moments as M


def money(value: str | Column) -> Column:
    """Exact cents: sums don't depend on their order."""
    return (F.col(value) if isinstance(value, str) else value).cast("decimal(18,2)")


def ratio(part: Column, whole: Column) -> Column:
    """Null-safe share; 0 of nothing is 0."""
    return F.when(whole > 0, F.round(part / whole, 6)).otherwise(0.0)


def kpis(df: DataFrame, value: str, ok: Column, error: Column) -> DataFrame:
    """One row: calls, errors, cost, mean of the good ones, error rate."""
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("calls"), F.count_if(error).alias("errors"), F.coalesce(F.sum(money(value)), F.lit(0)).cast("double").alias("cost"),
        F.round(F.avg(F.when(ok, money(value))), 4).cast("double").alias("mean_ok"), ratio(F.count_if(error).cast("double"), n).alias("error_rate"),
    )


def by_keys(df: DataFrame, keys: list[Column], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum(money(value)), F.lit(0)).cast("double").alias("cost"))


def daily(df: DataFrame, ts: str, key: str, value: str, zone: str = M.ZONE) -> DataFrame:
    """Per local day and key, with the day's total beside it."""
    rows = by_keys(df.withColumn("day", M.local_day(F.col(ts), zone)), [F.col("day"), F.col(key)], value)
    total = rows.groupBy("day").agg(F.sum("calls").alias("day_calls"), F.sum(money("cost")).cast("double").alias("day_cost"))
    return rows.join(total, "day")


def histogram(df: DataFrame, ts: str, hours: float | None, error: Column, zone: str = M.ZONE) -> DataFrame:
    """Counts per bucket of local time, as wide as the window asks for."""
    bucket = F.date_trunc(M.granularity(hours), M.local_time(F.col(ts), zone)).cast("timestamp_ntz")
    return df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(error).alias("errors"))


def percentiles(df: DataFrame, keys: list[str], number: Column, ranks: dict[str, float]) -> DataFrame:
    """Interpolated percentiles over the rows that have the number."""
    rows = df.withColumn("_x", number).where("_x IS NOT NULL")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.percentile("_x", F.lit(p)), 6).alias(k) for k, p in ranks.items()])


def top(df: DataFrame, key: str, n: int) -> DataFrame:
    """The most frequent values that aren't null, ties by the value."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(n)
