"""Queries over telemetry: roll-ups, histograms, percentiles, latest rows, pages, streaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import moments as M
from tracelake.operators import intervals, latest, metrics
from tracelake.sources.tables import events, table

SINCE, UNTIL = "2024-01-08 00:00:00", "2024-01-15 00:00:00"
BEFORE = "2024-01-01 00:00:00"
TODAY = "2024-01-30"


def _error():
    return F.col("event_type") == "error"


def _k():
    return F.get_json_object("props", "$.k").try_cast("double")


def a1_kpis(spark, d):
    rows = events(spark, d).where(M.half_open(F.col("ts"), SINCE, UNTIL))
    return metrics.kpis(rows, "value", ~_error(), _error())


def a2_previous_period(spark, d):
    rows = events(spark, d).withColumn("period", F.when(M.half_open(F.col("ts"), SINCE, UNTIL), "current").when(M.half_open(F.col("ts"), BEFORE, SINCE), "previous"))
    return metrics.by_keys(rows.where("period IS NOT NULL"), [F.col("period")], "value")


def a3_cost_by_source(spark, d):
    return metrics.by_keys(events(spark, d), [F.coalesce(F.col("user_id").cast("string"), F.lit("(no source)")).alias("source")], "value")


def a4_cost_by_module(spark, d):
    module = F.when(F.startswith("event_type", F.lit("s")), F.concat(F.lit("m_"), F.regexp_extract("event_type", "^s(.*)$", 1))).when(F.col("event_type").isin("view", "click"), "browsing").otherwise(F.col("event_type"))
    return metrics.by_keys(events(spark, d), [module.alias("module")], "value")


def a6_source_module_matrix(spark, d):
    return metrics.by_keys(events(spark, d), [F.col("user_id"), F.col("event_type")], "value")


def a7_daily_rollup(spark, d):
    return metrics.daily(events(spark, d), "ts", "event_type", "value")


def a8_distinct_pairs(spark, d):
    rows = events(spark, d)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct("user_id", "event_type")).alias("pairs"), F.count_distinct("user_id").alias("users"))


def a10_error_rate(spark, d):
    n = F.count(F.lit(1))
    return events(spark, d).groupBy("user_id").agg(n.alias("n"), F.count_if(_error()).alias("errors"), metrics.ratio(F.count_if(_error()).cast("double"), n).alias("error_rate"))


def a11_top_users(spark, d):
    return metrics.top(events(spark, d), "user_id", 20)


def a12_histogram(spark, d):
    rows = events(spark, d).where(M.half_open(F.col("ts"), "2024-01-08 00:00:00", "2024-01-11 00:00:00"))
    return metrics.histogram(rows, "ts", 72, _error())


def a13_percentiles(spark, d):
    return metrics.percentiles(events(spark, d), ["event_type"], _k(), {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def a15_balance(spark, d):
    """posted = signups + purchases + errors + views + clicks per user, and whether it holds."""
    kinds = ("signup", "purchase", "error", "view", "click")
    rows = events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("posted"), *[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])
    return rows.withColumn("balanced", F.col("posted") == sum((F.col(k) for k in kinds), F.lit(0)))


def a19_coverage(spark, d):
    """Days with purchases per user as ranges, at most two empty days inside one."""
    days = events(spark, d).where("event_type = 'purchase'").groupBy("user_id", M.local_day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return intervals.merged_days(days, ["user_id"], gap=2)


def a20_full_days(spark, d):
    """Days of a user without an error, as ranges that no day with one bridges."""
    days = events(spark, d).groupBy("user_id", M.local_day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(_error()).alias("open"))
    segment = F.sum(F.when(F.col("open") > 0, 1).otherwise(0)).over(latest.Window.partitionBy("user_id").orderBy("day"))
    full = days.withColumn("segment", segment).where("open = 0")
    return intervals.merged_days(full, ["user_id", "segment"], gap=30).drop("segment")


def a28_dense_days(spark, d):
    days = events(spark, d).groupBy("event_type", M.local_day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return intervals.dense_days(days, ["event_type"], "2023-12-25", "2024-01-31")


def a29_weeks(spark, d):
    week = F.to_date(F.date_trunc("week", M.local_time(F.col("ts"))))
    return events(spark, d).groupBy("user_id", week.alias("week")).agg(F.count(F.lit(1)).alias("n"))


def a30_streaks(spark, d):
    days = events(spark, d).select("user_id", M.local_day(F.col("ts")).alias("day")).distinct()
    return intervals.streaks(days, ["user_id"], TODAY)


def g2_merged_spans(spark, d):
    """Each purchase holds three days; overlapping spans of a user as one."""
    spans = events(spark, d).where("event_type = 'purchase'").select("user_id", M.local_day(F.col("ts")).alias("start_day"))
    return intervals.merged_spans(spans.withColumn("end_day", F.date_add("start_day", 3)), ["user_id"])


def g3_clipped_spans(spark, d):
    return intervals.clipped(g2_merged_spans(spark, d), "2024-01-10", "2024-01-20")


def n1_sparkline(spark, d):
    return latest.first_per_key(events(spark, d), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id", "rank")


def n3_ratio_to_mean(spark, d):
    counts = events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    mean = counts.agg(F.avg("n").alias("mean"))
    return counts.crossJoin(F.broadcast(mean)).select("user_id", "n", F.round(F.col("n") / F.col("mean"), 6).alias("ratio"))  # one row


def n4_keep_first(spark, d):
    rows = events(spark, d)
    keep = rows.groupBy("user_id", "event_type").agg(F.min("event_id").alias("keep_id"))
    return rows.join(keep, ["user_id", "event_type"]).select("event_id", "keep_id")


def n5_latest_per_key(spark, d):
    return latest.first_per_key(events(spark, d), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


def n8_keyset_page(spark, d):
    return latest.page_after(events(spark, d), "event_id", 500, 50).select("event_id", "user_id", "event_type")


def n9_offset_page(spark, d):
    return latest.page_at(events(spark, d), [F.desc("value"), F.col("event_id")], 40, 20).select("event_id", "value")


def n11_compact_window(spark, d):
    return latest.past_and_future(events(spark, d), "ts", "2024-01-15 12:00:00", 5, 7, "event_id").select("event_id", "ts")


def p2_include_exclude(spark, d):
    rows = events(spark, d).where(F.col("event_type").isin("error", "purchase") & ~F.col("user_id").isin(1, 2, 3))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def p3_search(spark, d):
    rows = events(spark, d).where(F.ilike("event_type", F.lit("%UR%")) | F.ilike("props", F.lit('%"k": 9%')))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def t8_windows(spark, d):
    """Sliding windows of two hours, each hour, over the event time."""
    w = F.window(F.col("ts").cast("timestamp"), "2 hours", "1 hour")
    return events(spark, d).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def t8_sessions(spark, d):
    """Sessions of a user with gaps of at most six hours."""
    s = F.session_window(F.col("ts").cast("timestamp"), "6 hours")
    return events(spark, d).groupBy("user_id", s.alias("s")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").cast("timestamp_ntz").alias("session_start"), "n")


def q_lineitem_rollup(spark, d):
    """The high-volume roll-up: exact sums by flag and status of lines shipped before a day."""
    money = lambda c: F.col(c).cast("decimal(18,2)")
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum(money("l_quantity")).cast("double").alias("quantity"), F.sum(money("l_extendedprice")).cast("double").alias("price"),
        F.sum(money("l_extendedprice") * (1 - money("l_discount"))).cast("double").alias("revenue"),
    )


_DAY = "CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Bogota' AS DATE)"
_LOCAL = "((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Bogota')"
_COST = "CAST(coalesce(sum(CAST(value AS DECIMAL(18,2))), 0) AS DOUBLE) AS cost"
_K = "TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)"
_ISLANDS = """SELECT user_id, min(day) AS start_day, max(day) AS end_day, CAST(sum(n) AS BIGINT) AS n, CAST(max(day) - min(day) + 1 AS BIGINT) AS days FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR day - prev > {gap} + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY day) AS island FROM (
    SELECT *, lag(day) OVER (PARTITION BY {keys} ORDER BY day) AS prev FROM ({days}))) GROUP BY {keys}, island"""
_PURCHASE_DAYS = f"SELECT user_id, {_DAY} AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY ALL"
_SPANS = f"""SELECT user_id, min(s) AS start_day, max(e) AS end_day FROM (
  SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, rn) AS island FROM (
    SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (
      SELECT user_id, s, s + 3 AS e, row_number() OVER (PARTITION BY user_id ORDER BY s) AS rn FROM (
        SELECT user_id, {_DAY} AS s FROM events WHERE event_type = 'purchase')))) GROUP BY user_id, island"""

SQL = {
    "a1_kpis": f"""SELECT count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, {_COST},
        round(CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type <> 'error') AS DOUBLE) / count(value) FILTER (event_type <> 'error'), 4) AS mean_ok,
        round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate
        FROM events WHERE ts >= TIMESTAMP '{SINCE}' AND ts < TIMESTAMP '{UNTIL}'""",
    "a2_previous_period": f"""SELECT CASE WHEN ts >= TIMESTAMP '{SINCE}' THEN 'current' ELSE 'previous' END AS period, count(*) AS calls, {_COST}
        FROM events WHERE ts >= TIMESTAMP '{BEFORE}' AND ts < TIMESTAMP '{UNTIL}' GROUP BY 1""",
    "a3_cost_by_source": f"SELECT coalesce(CAST(user_id AS VARCHAR), '(no source)') AS source, count(*) AS calls, {_COST} FROM events GROUP BY 1",
    "a4_cost_by_module": f"""SELECT CASE WHEN event_type LIKE 's%' THEN 'm_' || regexp_extract(event_type, '^s(.*)$', 1) WHEN event_type IN ('view', 'click') THEN 'browsing'
        ELSE event_type END AS module, count(*) AS calls, {_COST} FROM events GROUP BY 1""",
    "a6_source_module_matrix": f"SELECT user_id, event_type, count(*) AS calls, {_COST} FROM events GROUP BY 1, 2",
    "a7_daily_rollup": f"""WITH r AS (SELECT {_DAY} AS day, event_type, count(*) AS calls, sum(CAST(value AS DECIMAL(18,2))) AS c FROM events GROUP BY 1, 2)
        SELECT day, event_type, calls, CAST(c AS DOUBLE) AS cost, CAST(sum(calls) OVER (PARTITION BY day) AS BIGINT) AS day_calls,
        CAST(sum(c) OVER (PARTITION BY day) AS DOUBLE) AS day_cost FROM r""",
    "a8_distinct_pairs": "SELECT count(*) AS n, count(DISTINCT (user_id, event_type)) AS pairs, count(DISTINCT user_id) AS users FROM events",
    "a10_error_rate": """SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors,
        round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate FROM events GROUP BY 1""",
    "a11_top_users": "SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20",
    "a12_histogram": f"""SELECT date_trunc('hour', {_LOCAL}) AS bucket, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events
        WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-11' GROUP BY 1""",
    "a13_percentiles": f"""SELECT event_type, count({_K}) AS n, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY {_K}), 6) AS p50,
        round(percentile_cont(0.95) WITHIN GROUP (ORDER BY {_K}), 6) AS p95, round(percentile_cont(0.99) WITHIN GROUP (ORDER BY {_K}), 6) AS p99
        FROM events WHERE {_K} IS NOT NULL GROUP BY 1""",
    "a15_balance": """SELECT *, posted = signup + purchase + error + "view" + click AS balanced FROM (SELECT user_id, count(*) AS posted,
        count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'error') AS error,
        count(*) FILTER (event_type = 'view') AS "view", count(*) FILTER (event_type = 'click') AS click FROM events GROUP BY 1)""",
    "a19_coverage": _ISLANDS.format(gap=2, keys="user_id", days=_PURCHASE_DAYS),
    "a20_full_days": _ISLANDS.format(
        gap=30, keys="user_id, segment",
        days=f"""SELECT * FROM (SELECT *, sum(CASE WHEN open > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day) AS segment FROM (
            SELECT user_id, {_DAY} AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS open FROM events GROUP BY 1, 2)) WHERE open = 0""",
    ),
    "a28_dense_days": f"""SELECT event_type, day, coalesce(n, 0) AS n FROM (SELECT DISTINCT event_type FROM events)
        CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day)
        LEFT JOIN (SELECT event_type, {_DAY} AS day, count(*) AS n FROM events GROUP BY 1, 2) USING (event_type, day)""",
    "a29_weeks": f"SELECT user_id, CAST(date_trunc('week', {_LOCAL}) AS DATE) AS week, count(*) AS n FROM events GROUP BY 1, 2",
    "a30_streaks": f"""SELECT user_id, coalesce(max(CASE WHEN end_day IN (DATE '{TODAY}', DATE '{TODAY}' - 1) THEN days END), 0) AS streak FROM (
        {_ISLANDS.format(gap=0, keys="user_id", days=f"SELECT DISTINCT user_id, {_DAY} AS day, 1 AS n FROM events")}) GROUP BY 1""",
    "g2_merged_spans": _SPANS,
    "g3_clipped_spans": f"""SELECT user_id, greatest(start_day, DATE '2024-01-10') AS start_day, least(end_day, DATE '2024-01-20') AS end_day FROM ({_SPANS})
        WHERE start_day <= DATE '2024-01-20' AND end_day >= DATE '2024-01-10'""",
    "n1_sparkline": "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM events QUALIFY rank <= 10",
    "n3_ratio_to_mean": "SELECT user_id, n, round(n / avg(n) OVER (), 6) AS ratio FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)",
    "n4_keep_first": "SELECT event_id, min(event_id) OVER (PARTITION BY user_id, event_type) AS keep_id FROM events",
    "n5_latest_per_key": "SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id, value FROM events ORDER BY user_id, event_type, ts DESC, event_id DESC",
    "n8_keyset_page": "SELECT event_id, user_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 50",
    "n9_offset_page": "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20 OFFSET 40",
    "n11_compact_window": """(SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-15 12:00:00' ORDER BY ts DESC, event_id DESC LIMIT 5)
        UNION ALL (SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' ORDER BY ts, event_id LIMIT 7)""",
    "p2_include_exclude": "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'purchase') AND user_id NOT IN (1, 2, 3) GROUP BY 1",
    "p3_search": """SELECT event_type, count(*) AS n FROM events WHERE event_type ILIKE '%UR%' OR props ILIKE '%"k": 9%' GROUP BY 1""",
    "t8_windows": """SELECT CAST(w AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM (
        SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1, 2""",
    "t8_sessions": """SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (
        SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
          SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, s""",
    "q_lineitem_rollup": """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS revenue
        FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01' GROUP BY 1, 2""",
}
QUERIES = {name: globals()[name] for name in SQL}
