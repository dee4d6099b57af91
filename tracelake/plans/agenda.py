"""Queries over calendars: here each customer's orders are the entries of a calendar."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tracelake.operators import agenda
from tracelake.sources.tables import table

TITLES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
NOW = "1998-01-01 08:00:00"


def entries(spark, d):
    """Orders as entries: a week long, all day or at a time, by the order's number."""
    o = table(spark, d, "orders")
    n, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    at = F.when(n % 5 > 0, n * 977 % 86_400)
    return o.select(
        n.alias("id"), F.col("o_custkey").alias("customer"), day.alias("starts_on"), F.when(n % 11 == 0, F.date_add(day, 6)).alias("ends_on"), at.alias("start_s"),
        F.when(n % 3 == 0, at + 1800).alias("end_s"), F.col("o_orderpriority").alias("title"), F.when(n % 4 == 0, F.concat(F.lit("room "), (n % 7).cast("string"))).otherwise("").alias("location"),
        F.when(n % 2 == 0, F.col("o_orderstatus")).alias("description"), (n % 60).cast("int").alias("priority_rank"), (n % 13 == 0).alias("protected"),
        F.when(n % 3 == 1, "fill_only").otherwise("replace").alias("override_policy"), F.col("o_orderdate").alias("recency"),
        F.when(n % 6 > 0, F.col("o_totalprice") / 1e4).alias("lat"), F.when(n % 6 > 0, F.col("o_totalprice") / 2e4).alias("lng"),
    )


def g4_meeting_pairs(spark, d):
    return agenda.meeting_pairs(entries(spark, d), "id", ["customer"]).select("a_id", "b_id")


def g5_series(spark, d):
    """Customers' series: daily, weekly or monthly, some from the last day of a month."""
    k = F.col("c_custkey")
    start = F.date_add(F.lit("2023-01-01").cast("date"), (k * 37 % 365).cast("int"))
    every = F.when(k % 3 == 0, "daily").when(k % 3 == 1, "weekly").otherwise("monthly")
    rows = table(spark, d, "customer").select("c_custkey", start.alias("start"), every.alias("every"), F.date_add(start, (k % 200).cast("int")).alias("until"))
    return agenda.series(rows, "c_custkey")


def g6_arrivals(spark, d):
    """Whether to leave for each timed entry of the day, by a travel time that some lack."""
    rows = entries(spark, d).where("start_s IS NOT NULL AND starts_on = DATE'1998-01-01'")
    start = F.timestamp_seconds(F.unix_seconds(F.col("starts_on").cast("timestamp")) + F.col("start_s"))
    travel = F.when(F.col("lat").isNotNull(), F.col("id") % 7200)
    x = agenda.arrival(F.lit(NOW).cast("timestamp"), start, travel)
    return rows.select("id", x["verdict"].alias("verdict"), x["slack_seconds"].alias("slack_seconds"), F.unix_seconds(x["leave_by"]).alias("leave_by"))


def g7_next_entries(spark, d):
    """Each customer's next entry with a time and a place, within thirty days."""
    at = F.timestamp_seconds(F.unix_seconds(F.col("starts_on").cast("timestamp")) + F.col("start_s"))
    rows = agenda.next_entry(entries(spark, d).withColumn("at", at), ["customer"], "at", F.lit(NOW).cast("timestamp"), 30 * 86_400)
    return rows.select("customer", "id", F.unix_seconds("starts_at").alias("starts_at"))


def e3_duplicates(spark, d):
    """Entries of a customer that meet in time and are alike in title or place."""
    return agenda.duplicates(entries(spark, d), "id", ["customer"])


def _groups(spark, d):
    return agenda.consolidated(entries(spark, d), e3_duplicates(spark, d), _links(spark, d))


def _links(spark, d):
    """Consolidated ids from before: of two thirds of the entries, some for two of them."""
    return entries(spark, d).where("id % 3 > 0").select("id", F.floor(F.col("id") / 2).alias("cons_id"))


def e8_merged(spark, d):
    """The fields of each group of duplicates."""
    rows = entries(spark, d).join(_groups(spark, d).select("id", "cons_id"), "id")
    return agenda.merged(rows, "cons_id")


def e9_consolidated(spark, d):
    return _groups(spark, d)


def e11_tombstones(spark, d):
    return agenda.tombstones(_links(spark, d), _groups(spark, d))


def e12_conflicts(spark, d):
    """Important entries that overlap, against those stored: some pending, some decided."""
    found = agenda.conflicts(entries(spark, d), "id", ["customer"])
    stored = agenda.meeting_pairs(entries(spark, d), "id", ["customer"]).where("a_id % 2 = 0")
    stored = stored.select("a_id", "b_id", F.when(F.col("b_id") % 3 == 0, "pending").when(F.col("b_id") % 3 == 1, "dismissed").otherwise("resolved").alias("status"))
    return agenda.reconciled_conflicts(found, stored)


def a44_candidates(spark, d):
    """Candidates for one entry, both sides beside one another."""
    side = lambda p: entries(spark, d).select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "title", "location", "starts_on")])
    rows = e3_duplicates(spark, d).where("reason = 'time+location' OR score < 1")
    return rows.join(side("a"), "a_id").join(side("b"), "b_id")


def a45_conflicts(spark, d):
    """Conflicts by their two titles, whichever comes first: how many, the first and
    last day, and the one nearest to today."""
    side = lambda p: entries(spark, d).select(F.col("id").alias(f"{p}_id"), F.col("title").alias(f"{p}_title"), F.col("starts_on").alias(f"{p}_on"))
    shared = entries(spark, d).withColumn("customer", F.col("customer") % 10)  # ten calendars
    rows = agenda.conflicts(shared, "id", ["customer"]).join(side("a"), "a_id").join(side("b"), "b_id")
    away = F.abs(F.datediff("a_on", F.to_date(F.lit(NOW))))
    return rows.groupBy(F.least("a_title", "b_title").alias("one"), F.greatest("a_title", "b_title").alias("other")).agg(
        F.count(F.lit(1)).alias("n"), F.min("a_on").alias("first_on"), F.max("a_on").alias("last_on"), F.min_by("a_id", F.struct(away, "a_id", "b_id")).alias("nearest")
    )


def a46_members(spark, d):
    """Each consolidated entry with its members in order, and the highest rank among them."""
    rows = _groups(spark, d).join(entries(spark, d).select("id", "priority_rank"), "id")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",")
    return rows.groupBy("cons_id").agg(ids.alias("members"), F.max("priority_rank").alias("priority_rank"))


def n7_winners(spark, d):
    """The best entry of each customer."""
    best = F.row_number().over(agenda.Window.partitionBy("customer").orderBy(*agenda.order_of_merit()))
    return entries(spark, d).withColumn("n", best).where("n = 1").select("customer", "id", "protected", "priority_rank")


_E = """SELECT o_orderkey AS id, o_custkey AS customer, CAST(o_orderdate AS DATE) AS starts_on, CASE WHEN o_orderkey % 11 = 0 THEN CAST(o_orderdate AS DATE) + 6 END AS ends_on,
    CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey * 977 % 86400 END AS start_s, CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 3 = 0 THEN o_orderkey * 977 % 86400 + 1800 END AS end_s,
    o_orderpriority AS title, CASE WHEN o_orderkey % 4 = 0 THEN 'room ' || o_orderkey % 7 ELSE '' END AS location, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS description,
    CAST(o_orderkey % 60 AS INTEGER) AS priority_rank, o_orderkey % 13 = 0 AS protected, CASE WHEN o_orderkey % 3 = 1 THEN 'fill_only' ELSE 'replace' END AS override_policy,
    o_orderdate AS recency, CASE WHEN o_orderkey % 6 > 0 THEN o_totalprice / 1e4 END AS lat FROM orders"""
_S = f"""SELECT *, ends_on IS NULL AND start_s IS NOT NULL AS timed, epoch(starts_on)::BIGINT + start_s AS s,
    epoch(starts_on)::BIGINT + CASE WHEN end_s > start_s THEN end_s ELSE start_s + 3600 END AS e, coalesce(ends_on, starts_on) AS last FROM ({_E})"""
_DAYS = "a.customer = b.customer AND a.id < b.id AND a.starts_on <= b.last AND b.starts_on <= a.last"
_MEET = f"""SELECT a.id AS a_id, b.id AS b_id, a.title AS a_title, b.title AS b_title, a.location AS a_place, b.location AS b_place FROM ({_S}) a JOIN ({_S}) b ON {_DAYS}
    AND (NOT a.timed OR NOT b.timed OR (a.s <= b.e + 1800 AND b.s <= a.e + 1800))"""
_ALIKE = ", ".join(f"('{a}', '{b}', {SequenceMatcher(None, a.lower(), b.lower()).ratio()!r}::DOUBLE)" for a in TITLES for b in TITLES)
#: Names of rooms differ in their last letter, so five of six letters match.
_DUPLICATES = f"""SELECT a_id, b_id, CASE WHEN title >= 0.85 THEN 'time+title' ELSE 'time+location' END AS reason, round(greatest(title, place), 3) AS score FROM (
    SELECT a_id, b_id, r AS title, CASE WHEN a_place = '' OR b_place = '' THEN 0 WHEN a_place = b_place THEN 1 ELSE CAST(10 AS DOUBLE) / 12 END AS place
    FROM ({_MEET}) JOIN (VALUES {_ALIKE}) v(x, y, r) ON x = a_title AND y = b_title) WHERE title >= 0.85 OR place >= 0.85"""
_LINKS = "SELECT o_orderkey AS id, o_orderkey // 2 AS cons_id FROM orders WHERE o_orderkey % 3 > 0"
_CONS = f"""WITH RECURSIVE p AS MATERIALIZED ({_DUPLICATES}), l AS (SELECT a_id AS x, b_id AS y FROM p UNION ALL SELECT b_id, a_id FROM p),
    reach AS (SELECT o_orderkey AS x, o_orderkey AS y FROM orders UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
    g AS (SELECT x AS id, min(y) AS root FROM reach GROUP BY 1), k AS ({_LINKS}), m AS (SELECT root, min(cons_id) AS kept, count(*) AS n, count(cons_id) AS had, count(DISTINCT cons_id) AS ofs
    FROM g LEFT JOIN k USING (id) GROUP BY 1)
    SELECT id, coalesce(kept, (SELECT max(cons_id) FROM k) + 1 + root) AS cons_id, CASE WHEN kept IS NULL THEN 'new' WHEN had = n AND ofs = 1
    AND n = (SELECT count(*) FROM k WHERE k.cons_id = kept) THEN 'kept' ELSE 'changed' END AS state FROM g JOIN m USING (root)"""
_MERIT = "protected DESC, priority_rank DESC, recency DESC, id"

SQL = {
    "g4_meeting_pairs": f"SELECT a_id, b_id FROM ({_MEET})",
    "g5_series": """WITH c AS (SELECT c_custkey AS id, DATE '2023-01-01' + CAST(c_custkey * 37 % 365 AS INTEGER) AS s, DATE '2023-01-01' + CAST(c_custkey * 37 % 365 + c_custkey % 200 AS INTEGER) AS u FROM customer),
        x AS (SELECT id, s, unnest(generate_series(s, u, INTERVAL 1 DAY))::DATE AS day FROM c)
        SELECT id, day FROM x WHERE id % 3 = 0 OR (id % 3 = 1 AND (day - s) % 7 = 0) OR (id % 3 = 2 AND extract(day FROM day) = extract(day FROM s))""",
    "g6_arrivals": f"""SELECT id, CASE WHEN travel IS NULL THEN 'unknown' WHEN slack < 0 THEN 'late' WHEN slack <= 1800 THEN 'leave_now' ELSE 'on_time' END AS verdict, slack AS slack_seconds,
        s - travel - 600 AS leave_by FROM (SELECT id, s, travel, s - travel - 600 - epoch(TIMESTAMP '{NOW}')::BIGINT AS slack FROM (
        SELECT id, s, CASE WHEN lat IS NOT NULL THEN id % 7200 END AS travel FROM ({_S}) WHERE start_s IS NOT NULL AND starts_on = DATE '1998-01-01'))""",
    "g7_next_entries": f"""SELECT customer, id, s AS starts_at FROM ({_S}) WHERE start_s IS NOT NULL AND lat IS NOT NULL AND s - epoch(TIMESTAMP '{NOW}')::BIGINT BETWEEN 1 AND 30 * 86400
        QUALIFY row_number() OVER (PARTITION BY customer ORDER BY s, id) = 1""",
    "e3_duplicates": _DUPLICATES,
    "e8_merged": f"""WITH r AS (SELECT e.*, cons_id, row_number() OVER (PARTITION BY cons_id ORDER BY {_MERIT}) AS rn FROM ({_E}) e JOIN ({_CONS}) USING (id)),
        f AS (SELECT cons_id, arg_min(location, rn) FILTER (location <> '') AS fl, arg_min(description, rn) FILTER (description <> '') AS fd, arg_min(end_s, rn) FILTER (end_s IS NOT NULL) AS fe,
        arg_min(ends_on, rn) FILTER (ends_on IS NOT NULL) AS fo FROM r GROUP BY 1)
        SELECT cons_id, id AS winner, title, starts_on, start_s, CASE WHEN override_policy = 'fill_only' THEN coalesce(fl, location) ELSE location END AS location,
        CASE WHEN override_policy = 'fill_only' THEN coalesce(fd, description) ELSE description END AS description,
        CASE WHEN override_policy = 'fill_only' THEN coalesce(fe, end_s) ELSE end_s END AS end_s, CASE WHEN override_policy = 'fill_only' THEN coalesce(fo, ends_on) ELSE ends_on END AS ends_on
        FROM r JOIN f USING (cons_id) WHERE rn = 1""",
    "e9_consolidated": _CONS,
    "e11_tombstones": f"""SELECT k.cons_id, arg_min(n.cons_id, k.id) AS merged_into FROM ({_LINKS}) k LEFT JOIN ({_CONS}) n ON n.id = k.id
        WHERE k.cons_id NOT IN (SELECT cons_id FROM ({_CONS})) GROUP BY 1""",
    "e12_conflicts": f"""WITH f AS (SELECT a.id AS a_id, b.id AS b_id FROM ({_S}) a JOIN ({_S}) b ON {_DAYS} AND a.timed AND b.timed AND a.s < b.e AND b.s < a.e
        AND (a.protected OR a.priority_rank >= 50) AND (b.protected OR b.priority_rank >= 50)),
        t AS (SELECT a_id, b_id, CASE b_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'dismissed' ELSE 'resolved' END AS status FROM ({_MEET}) WHERE a_id % 2 = 0)
        SELECT a_id, b_id, coalesce(status, 'pending') AS status FROM t FULL JOIN (SELECT *, true AS found FROM f) USING (a_id, b_id) WHERE found OR status <> 'pending'""",
    "a44_candidates": f"""SELECT p.*, a.title AS a_title, a.location AS a_location, a.starts_on AS a_starts_on, b.title AS b_title, b.location AS b_location, b.starts_on AS b_starts_on
        FROM ({_DUPLICATES}) p JOIN ({_E}) a ON a.id = a_id JOIN ({_E}) b ON b.id = b_id WHERE reason = 'time+location' OR score < 1""",
    "a45_conflicts": f"""SELECT least(a.title, b.title) AS one, greatest(a.title, b.title) AS other, count(*) AS n, min(a.starts_on) AS first_on, max(a.starts_on) AS last_on,
        arg_min(a.id, (abs(a.starts_on - CAST(TIMESTAMP '{NOW}' AS DATE)), a.id, b.id)) AS nearest FROM ({_S}) a JOIN ({_S}) b ON {_DAYS.replace("a.customer = b.customer", "a.customer % 10 = b.customer % 10")} AND a.timed AND b.timed AND a.s < b.e AND b.s < a.e
        AND (a.protected OR a.priority_rank >= 50) AND (b.protected OR b.priority_rank >= 50) GROUP BY 1, 2""",
    "a46_members": f"""SELECT cons_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members, max(id % 60)::INTEGER AS priority_rank FROM ({_CONS}) GROUP BY 1""",
    "n7_winners": f"SELECT customer, id, protected, priority_rank FROM ({_E}) QUALIFY row_number() OVER (PARTITION BY customer ORDER BY {_MERIT}) = 1",
}
QUERIES = {name: globals()[name] for name in SQL}
