"""Where a transaction was: the nearest fix of its user's device, the fix's cell, the cell's place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.text import either_contains
from tracelake.operators.joins import nearest_in_time

#: Decimals of a cell, metres a second from which a fix is in transit, metres of a degree (fixed values).
DECIMALS, MOVING, DEGREE = 4, 1.5, 111_000.0


def cell(degrees: Column) -> Column:
    """Degrees as a cell has them: to even at half."""
    return F.bround(degrees.cast("decimal(18,8)"), DECIMALS)


def fixes_with_speed(fixes: DataFrame) -> DataFrame:
    """(user, at, lat, lng) with in_transit: faster than MOVING since the user's fix before."""
    w = Window.partitionBy("user").orderBy("at", "lat", "lng")
    seconds = (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.lag("at").over(w).cast("timestamp"))) / 1e6
    north, east = (F.col("lat") - F.lag("lat").over(w)) * DEGREE, (F.col("lng") - F.lag("lng").over(w)) * DEGREE * F.cos(F.radians("lat"))
    speed = F.sqrt(north * north + east * east) / F.when(seconds > 0, seconds)
    return fixes.withColumn("in_transit", F.coalesce(speed > MOVING, F.lit(False)))


def enriched(transactions: DataFrame, fixes: DataFrame, cells: DataFrame, stale: int) -> DataFrame:
    """Transactions (id, user, at, place, exact, done) with an outcome and, where a place
    was found, that place in place of the one read from the text, which is kept: skipped
    (no exact time, or done before), no_fix (none within `stale` seconds: stays to be
    done), in_transit, no_result (the cell has no known place), resolved. `cells`: (lat,
    lng, name), one a cell; `matches_extracted`: one of both names holds the other."""
    todo = F.col("exact") & ~F.coalesce("done", F.lit(False))
    near = nearest_in_time(transactions.where(todo), fixes_with_speed(fixes), ["user"], "at", ["lat", "lng", "in_transit"], stale)
    known = cells.select(F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), "name")
    rows = near.withColumns({"_lat": cell(F.col("near_lat")), "_lng": cell(F.col("near_lng"))}).join(known, ["_lat", "_lng"], "left")
    outcome = F.when(F.col("near_at").isNull(), "no_fix").when(F.col("near_in_transit"), "in_transit").when(F.col("name").isNull(), "no_result").otherwise("resolved")
    rows = rows.withColumn("outcome", outcome).withColumn("found", F.when(F.col("outcome") == "resolved", F.col("name")))
    got = rows.select(
        "id", "user", "outcome", F.coalesce("found", "place").alias("place"), F.when(F.col("found").isNotNull(), F.col("place")).alias("place_extracted"),
        F.when(F.col("found").isNotNull(), F.coalesce(either_contains(F.col("place"), F.col("found")), F.lit(False))).alias("matches_extracted"),
    )
    rest = transactions.where(~F.coalesce(todo, F.lit(False)))
    return got.unionByName(rest.select("id", "user", F.lit("skipped").alias("outcome"), "place", F.lit(None).cast("string").alias("place_extracted"), F.lit(None).cast("boolean").alias("matches_extracted")))
