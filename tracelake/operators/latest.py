"""Latest and best row per key, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first `n` rows of each key in the order (with a rank if n > 1). Spark
    limits the groups before its shuffle, so a hot key moves few rows."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
    return ranked if n > 1 else ranked.drop("rank")


def page_after(df: DataFrame, key: str, cursor: int | None, size: int, descending: bool = False) -> DataFrame:
    """A page of rows beyond the cursor, by an ordered key."""
    beyond = df if cursor is None else df.where(F.col(key) < cursor if descending else F.col(key) > cursor)
    return beyond.orderBy(F.desc(key) if descending else F.asc(key)).limit(size)


def page_at(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """A page by offset; its cost grows with the offset."""
    return df.orderBy(*order).offset(offset).limit(size)


def sorted_by(df: DataFrame, allowed: dict[str, str], sort: str, descending: bool, tie: str) -> DataFrame:
    """Sort by a column of a list of allowed ones, ties by id; null values last."""
    column = F.col(allowed[sort])
    return df.orderBy(column.desc_nulls_last() if descending else column.asc_nulls_last(), F.col(tie).desc() if descending else F.col(tie).asc())


def past_and_future(df: DataFrame, ts: str, now: str, past: int, future: int, tie: str) -> DataFrame:
    """The last `past` rows before an instant and the first `future` from it on."""
    at = F.lit(now).cast("timestamp_ntz")
    before = df.where(F.col(ts) < at).orderBy(F.desc(ts), F.desc(tie)).limit(past)
    after = df.where(F.col(ts) >= at).orderBy(ts, tie).limit(future)
    return before.unionByName(after)
