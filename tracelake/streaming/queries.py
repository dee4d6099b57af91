"""Queries through streams that keep state, follow rules that change, or poll."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.operators.rules import Rule
from tracelake.shared import new_path
from tracelake.sources import polling
from tracelake.sources.tables import events
from tracelake.store import Store
from tracelake.streaming import live, notices

#: Days that a notice is due after its last emission.
DUE = 3

#: Files of a trigger that takes all there are.
WHOLE = (1 << 31) - 1

#: The rules of the first, second and third part of the events.
VERSIONS = (
    [Rule(1, "ignore", {"k": {"prefix": "9"}}), Rule(2, "ignore", {"k": {"regex": "^1"}}, priority=5)],
    [Rule(1, "ignore", {"k": {"prefix": "9"}}, enabled=False), Rule(2, "ignore", {"k": {"regex": "^1"}}, priority=5), Rule(3, "ignore", {"k": {"in": [20, 21, 22]}}, priority=7)],
    [Rule(3, "keep", {"k": {"in": [20, 21, 22]}}, priority=7), Rule(4, "ignore", {"k": {"prefix": "2"}})],
)


def _parts(spark, d, number: int, by: Column | None = None):
    """The events in so many files of a folder, by number or another column of longs, one of them after the other."""
    rows, by = events(spark, d), F.col("event_id") if by is None else by
    span = rows.agg(F.min(by).alias("low"), (F.max(by) + 1).alias("high")).first()
    folder, cuts = new_path(spark, "parts"), [span["low"] + (span["high"] - span["low"]) * k // number for k in range(number + 1)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        yield folder, rows.where((by >= low) & (by < high))


def _actions(rows):
    """Events as actions on notices: most emit, a view reads, a click dismisses."""
    at = F.col("ts").cast("timestamp")
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0))
    return rows.select(
        "user_id", (k % 3).cast("string").alias("dedup_key"), F.col("event_id").alias("seq"), at.alias("at"), F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "click", "dismiss").otherwise("emit").alias("op"),
        F.col("value").cast("string").alias("content"), (at + F.expr(f"INTERVAL {DUE} DAYS")).alias("expires_at"),
    )


def t10_notices(spark, d):
    """Notices made of the events by a stream in four batches; purged ones are those that the watermark has passed.
    The batches are spans of time, not of numbers: what has a higher number may be earlier, and would come too late.
    Each batch has as many files as its tasks wrote; the stream goes on from its checkpoint when they are there."""
    target, state = new_path(spark, "notices"), new_path(spark, "state")
    for folder, part in _parts(spark, d, 4, F.unix_micros(F.col("ts").cast("timestamp"))):
        part.write.mode("append").parquet(folder)
        notices.kept_queue(_actions(live.stream(spark, folder, WHOLE)), "1 hour", target, state).awaitTermination()
    micros = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    got = notices.notices(spark.read.parquet(target))
    return got.select("user_id", "dedup_key", *[micros(c) for c in ("created", "read", "dismissed", "expires")], "content", "emitted", "purged")


def t4_live_rules(spark, d):
    """A running stream whose rules change between its batches: what each version dropped and kept."""
    store = Store(spark, new_path(spark, "rules"), live.RULE_TABLES, 2)
    target, checkpoint, query = new_path(spark, "ruled"), new_path(spark, "state"), None
    try:
        for (folder, part), version in zip(_parts(spark, d, len(VERSIONS)), VERSIONS, strict=True):
            before = store.snapshot()
            rows = spark.createDataFrame([(r.id, r.action, json.dumps(r.scope), r.priority, r.enabled, False) for r in version], live.RULE_TABLES["rules"].ddl + ", gone boolean")
            gone = before.table("rules").join(rows, "id", "left_anti").withColumn("gone", F.lit(True))
            store.commit(before, {"rules": rows.unionByName(gone)})
            part.coalesce(1).write.mode("append").parquet(folder)
            query = query or live.ruled(live.stream(spark, folder), store, target, checkpoint, payload="props")
            query.processAllAvailable()
    finally:
        if query is not None:
            query.stop()
    kept = spark.read.parquet(f"{target}/kept").groupBy("rules").agg(F.count(F.lit(1)).alias("n")).withColumn("rule_id", F.lit(None).cast("long"))
    drops = spark.read.parquet(f"{target}/drops").groupBy("rules", "rule_id").agg(F.sum("dropped").alias("n"))
    return kept.select("rules", "rule_id", "n").unionByName(drops.select("rules", "rule_id", "n"))


def s4_polled(spark, d):
    """The events, polled in batches of a fifth of them: each user's records and batches."""
    polling.registered(spark)
    n = events(spark, d).count()
    cursor = f"{new_path(spark, 'cursor')}/at.json"
    options = {"path": f"{d}/events.parquet", "id": "event_id", "account": "user_id", "limit": max(1, -(-n // 5)), "cursor": cursor}
    rows = spark.readStream.format("polled").schema(events(spark, d).schema).options(**options).load()
    target = new_path(spark, "polled")
    query = live.appended(rows, target, new_path(spark, "state"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.parquet(target).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count_distinct("batch").alias("batches"))


def s4_pushed(spark, d):
    """The same source as a table: conditions on ids and accounts are the reader's."""
    polling.registered(spark)
    rows = spark.read.format("polled").options(path=f"{d}/events.parquet", id="event_id", account="user_id").load()
    return rows.where("event_id >= 100 AND user_id = 7 AND value > 10").select("event_id", "event_type", "value")


_VERSION = "CASE WHEN event_id < {0} THEN 1 WHEN event_id < {1} THEN 2 ELSE 3 END"
_CUTS = "(SELECT min(event_id) + (max(event_id) + 1 - min(event_id)) * {0} // 3 FROM events)"

SQL = {
    "t10_notices": f"""WITH e AS (SELECT event_id, user_id, CAST(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) % 3 AS VARCHAR) AS dedup_key, ts, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'dismiss' ELSE 'emit' END AS op,
          CAST(value AS VARCHAR) AS content FROM events),
        l AS (SELECT *, max(CASE WHEN op = 'emit' THEN ts END) OVER (PARTITION BY user_id, dedup_key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e),
        n AS (SELECT *, sum(CASE WHEN op = 'emit' AND (last IS NULL OR last + INTERVAL {DUE} DAY <= ts) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, dedup_key ORDER BY ts, event_id) AS life FROM l WHERE op = 'emit' OR last + INTERVAL {DUE} DAY > ts),
        g AS (SELECT user_id, dedup_key, min(ts) FILTER (op = 'emit') AS created, min(ts) FILTER (op = 'read') AS "read", min(ts) FILTER (op = 'dismiss') AS dismissed, max(ts) FILTER (op = 'emit') + INTERVAL {DUE} DAY AS expires,
          arg_max(content, (ts, event_id)) FILTER (op = 'emit') AS content, count(*) FILTER (op = 'emit') AS emitted, life FROM n GROUP BY user_id, dedup_key, life)
        SELECT user_id, dedup_key, created, "read", dismissed, expires, content, emitted, expires <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR OR life < max(life) OVER (PARTITION BY user_id, dedup_key) AS purged FROM g""",
    "t4_live_rules": f"""WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k, {_VERSION.format(_CUTS.format(1), _CUTS.format(2))} AS rules FROM events),
        r AS (SELECT rules, CASE rules WHEN 1 THEN CASE WHEN k LIKE '1%' THEN 2 WHEN k LIKE '9%' THEN 1 END WHEN 2 THEN CASE WHEN k IN ('20', '21', '22') THEN 3 WHEN k LIKE '1%' THEN 2 END
          ELSE CASE WHEN k IN ('20', '21', '22') THEN NULL WHEN k LIKE '2%' THEN 4 END END AS rule_id FROM e)
        SELECT CAST(rules AS BIGINT) AS rules, CAST(rule_id AS BIGINT) AS rule_id, count(*) AS n FROM r GROUP BY 1, 2""",
    "s4_polled": """WITH s AS (SELECT count(*) AS n FROM events) SELECT user_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, count(DISTINCT event_id // ((n + 4) // 5)) AS batches FROM events, s GROUP BY user_id""",
    "s4_pushed": "SELECT event_id, event_type, value FROM events WHERE event_id >= 100 AND user_id = 7 AND value > 10",
}
QUERIES = {name: globals()[name] for name in SQL}
