"""Calendar entries: overlaps, duplicates, merging, conflicts, series, arrivals.

An entry has an id, starts_on and ends_on (dates, the latter null for one day),
start_s and end_s (seconds of the day, null without a time), a title and a place.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tracelake.functions import text as T
from tracelake.operators.components import components

#: Seconds: of an entry without an end, and what two entries may lie apart (fixed values).
DEFAULT_LENGTH, TOLERANCE = 3600, 1800
#: Least similarity of titles and of places, and the rank from which an entry is important (fixed values).
ALIKE, IMPORTANT = 0.85, 50
#: Instances of a series at most.
MOST_INSTANCES = 400


@F.pandas_udf(DoubleType())
def matching(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two strings, which isn't symmetric."""
    known: dict[tuple[str, str], float] = {}
    for pair in zip(a, b, strict=True):
        if pair not in known:
            known[pair] = SequenceMatcher(None, *pair).ratio()
    return pd.Series([known[pair] for pair in zip(a, b, strict=True)], dtype=float)


def _spans(df: DataFrame, ident: str, keys: list[str], side: str) -> DataFrame:
    day = F.datediff("starts_on", F.lit("1970-01-01").cast("date")).cast("long")
    start = day * 86_400 + F.col("start_s")
    end = day * 86_400 + F.when(F.col("end_s") > F.col("start_s"), F.col("end_s")).otherwise(F.col("start_s") + DEFAULT_LENGTH)
    last = F.coalesce("ends_on", "starts_on")
    timed = F.col("ends_on").isNull() & F.col("start_s").isNotNull()
    return df.select(
        F.col(ident).alias(f"{side}_id"), *keys, F.col("starts_on").alias(f"{side}_first"),
        F.when(timed, start).alias(f"{side}_start"), F.when(timed, end).alias(f"{side}_end"),
        F.explode(F.sequence("starts_on", F.greatest("starts_on", last))).alias("day"),
    )


def meeting_pairs(df: DataFrame, ident: str, keys: list[str], tolerance: int = TOLERANCE, strict: bool = False) -> DataFrame:
    """(a_id, b_id), a_id < b_id, with equal keys, whose dates touch; if both have a
    time on a single day, the times must be `tolerance` seconds apart at most.
    `strict`: only such entries, whose times overlap by more than an edge. Each
    entry is filed under each of its days; a pair counts on the first they share."""
    a, b = _spans(df, ident, keys, "a"), _spans(df, ident, keys, "b")
    both = F.col("a_start").isNotNull() & F.col("b_start").isNotNull()
    if strict:
        near = both & (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end"))
    else:
        near = ~both | (F.col("a_start") <= F.col("b_end") + tolerance) & (F.col("b_start") <= F.col("a_end") + tolerance)
    first = F.col("day") == F.greatest("a_first", "b_first")
    return a.join(b, [*keys, "day"]).where((F.col("a_id") < F.col("b_id")) & first & near).select("a_id", "b_id", *keys)


def duplicates(df: DataFrame, ident: str, keys: list[str], least: float = ALIKE) -> DataFrame:
    """(a_id, b_id, reason, score) of entries that meet in time and have alike
    titles, or alike places that aren't blank; the score is the larger likeness."""
    side = lambda p: df.select(F.col(ident).alias(f"{p}_id"), T.normalized(F.col("title")).alias(f"{p}_title"), T.normalized(F.coalesce("location", F.lit(""))).alias(f"{p}_place"))
    rows = meeting_pairs(df, ident, keys).join(side("a"), "a_id").join(side("b"), "b_id")
    blank = (F.col("a_place") == "") | (F.col("b_place") == "")
    rows = rows.withColumns({"title": matching("a_title", "b_title"), "place": F.when(blank, 0.0).otherwise(matching("a_place", "b_place"))})
    rows = rows.where((F.col("title") >= least) | (F.col("place") >= least))
    reason = F.when(F.col("title") >= least, "time+title").otherwise("time+location")
    return rows.select("a_id", "b_id", reason.alias("reason"), F.round(F.greatest("title", "place"), 3).alias("score"))


def order_of_merit() -> list[Column]:
    """Protected first, then by rank, recency and id."""
    return [F.desc("protected"), F.desc("priority_rank"), F.desc("recency"), F.col("id")]


def merged(df: DataFrame, group: str) -> DataFrame:
    """(group, winner, title, starts_on, start_s, location, description, end_s,
    ends_on): the best entry of each group; if its policy is fill_only, what it
    leaves empty comes from the next best that has it."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order_of_merit())))
    fill = {"location": F.col("location") != "", "description": F.col("description") != "", "end_s": F.col("end_s").isNotNull(), "ends_on": F.col("ends_on").isNotNull()}
    first = F.col("_rank") == 1
    own = lambda c: F.max(F.when(first, F.col(c)))
    got = ranked.groupBy(group).agg(
        own("id").alias("winner"), own("title").alias("title"), own("starts_on").alias("starts_on"), own("start_s").alias("start_s"), own("override_policy").alias("policy"),
        *[own(c).alias(f"own_{c}") for c in fill], *[F.min_by(c, F.when(full, F.col("_rank"))).alias(f"any_{c}") for c, full in fill.items()],
    )
    filled = [F.when(F.col("policy") == "fill_only", F.coalesce(f"any_{c}", f"own_{c}")).otherwise(F.col(f"own_{c}")).alias(c) for c in fill]
    return got.select(group, "winner", "title", "starts_on", "start_s", *filled)


def conflicts(df: DataFrame, ident: str, keys: list[str]) -> DataFrame:
    """Pairs of important entries whose times overlap."""
    return meeting_pairs(df.where(F.col("protected") | (F.col("priority_rank") >= IMPORTANT)), ident, keys, strict=True)


def reconciled_conflicts(found: DataFrame, stored: DataFrame) -> DataFrame:
    """(a_id, b_id, status): pending ones that aren't found any more go, decisions stay, new ones are pending."""
    both = stored.join(found.select("a_id", "b_id", F.lit(True).alias("_found")), ["a_id", "b_id"], "full")
    return both.where("_found OR status <> 'pending'").select("a_id", "b_id", F.coalesce("status", F.lit("pending")).alias("status"))


def consolidated(ids: DataFrame, pairs: DataFrame, links: DataFrame) -> DataFrame:
    """(id, cons_id, state) of entries grouped by the pairs: a group keeps the
    smallest consolidated id that its members had (links: id, cons_id), else it
    gets a new one, beyond all there are; kept, changed or new, by its members."""
    roots = components(pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))).withColumnRenamed("vertex", "id")
    rows = ids.select("id").distinct().join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")).join(links, "id", "left")
    before = links.groupBy("cons_id").agg(F.count(F.lit(1)).alias("_before"))
    most = links.agg(F.coalesce(F.max("cons_id"), F.lit(0)).alias("_most"))
    groups = rows.groupBy("root").agg(F.min("cons_id").alias("kept"), F.count(F.lit(1)).alias("n"), F.count("cons_id").alias("had"), F.count_distinct("cons_id").alias("of"))
    groups = groups.join(before, F.col("kept") == F.col("cons_id"), "left").crossJoin(F.broadcast(most))  # one row
    same = (F.col("n") == F.col("_before")) & (F.col("had") == F.col("n")) & (F.col("of") == 1)
    state = F.when(F.col("kept").isNull(), "new").when(same, "kept").otherwise("changed")
    named = groups.select("root", F.coalesce("kept", F.col("_most") + 1 + F.col("root")).alias("cons_id"), state.alias("state"))
    return rows.select("id", "root").join(named, "root").select("id", "cons_id", "state")


def tombstones(links: DataFrame, now: DataFrame) -> DataFrame:
    """Consolidated ids that no entry has any more, with the one that their first
    entry went to (null where its entries are gone)."""
    gone = links.join(now.select("cons_id").distinct(), "cons_id", "left_anti")
    to = gone.join(now.select("id", F.col("cons_id").alias("into")), "id", "left")
    return to.groupBy("cons_id").agg(F.min_by("into", "id").alias("merged_into"))


def series(rows: DataFrame, ident: str) -> DataFrame:
    """(id, day) of each series (start, every, until): daily, weekly, or monthly on
    the same day of the month, months without it left out. Longer series than
    MOST_INSTANCES give an error."""
    step = F.when(F.col("every") == "daily", F.lit(1)).when(F.col("every") == "weekly", F.lit(7))
    spans = F.when(step.isNotNull(), F.sequence(F.lit(0), F.datediff("until", "start"))).otherwise(
        F.sequence(F.lit(0), (F.year("until") - F.year("start")) * 12 + F.month("until") - F.month("start"))
    )
    each = rows.where("until >= start").select(F.col(ident).alias("id"), "start", "until", step.alias("step"), F.explode(spans).alias("i"))
    month = F.add_months(F.trunc("start", "month"), F.col("i"))
    monthly = F.when(F.dayofmonth("start") <= F.dayofmonth(F.last_day(month)), F.date_add(month, F.dayofmonth("start") - 1))
    daily = F.when(F.col("i") % F.col("step") == 0, F.date_add("start", F.col("i")))
    days = each.select("id", "until", F.when(F.col("step").isNotNull(), daily).otherwise(monthly).alias("day")).where("day <= until")
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    return days.select("id", F.when(n <= MOST_INSTANCES, F.col("day")).otherwise(F.raise_error(F.lit("a series has too many instances"))).alias("day"))


def arrival(now: Column, start: Column, travel_seconds: Column, buffer: int = 600, lead: int = 1800) -> Column:
    """verdict, leave_by and slack_seconds: late, leave_now, on_time, or unknown without a travel time."""
    leave = F.timestamp_seconds(F.unix_seconds(start) - travel_seconds - buffer)
    slack = F.unix_seconds(start) - travel_seconds - buffer - F.unix_seconds(now)
    verdict = F.when(travel_seconds.isNull(), "unknown").when(slack < 0, "late").when(slack <= lead, "leave_now").otherwise("on_time")
    return F.struct(verdict.alias("verdict"), leave.alias("leave_by"), slack.alias("slack_seconds"))


def next_entry(df: DataFrame, keys: list[str], at: str, now: Column, horizon_seconds: int) -> DataFrame:
    """The first entry of each key with a time and coordinates after `now`, within the horizon."""
    seconds = F.unix_seconds(F.col(at)) - F.unix_seconds(now)
    usable = df.where(F.col(at).isNotNull() & F.col("lat").isNotNull() & F.col("lng").isNotNull() & seconds.between(1, horizon_seconds))
    return usable.groupBy(*keys).agg(F.min_by("id", F.struct(at, "id")).alias("id"), F.min(at).alias("starts_at"))
