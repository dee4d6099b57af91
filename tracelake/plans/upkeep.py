"""Queries over runs, work sets, stored state and the lists of a dashboard."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.operators import ingest, latest
from tracelake.plans.messages import events, messages, table
from tracelake.sources.tables import transactions

NOW = "2024-01-31 00:00:00"
#: Modules, the kinds of messages they read, and the modules they wait for.
MODULES = (("finance", "click,purchase", ""), ("calendar", "view", "finance"), ("people", "click,signup", "finance,calendar"), ("health", "error", ""), ("graph", "click,view", "people"))


def _k():
    return F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0))


def _calls(spark, d):
    """Events as model calls: tokens, cost, model, platform; views cost nothing."""
    e, k = events(spark, d), _k()
    cost = F.when(F.col("event_type") == "view", F.lit(0)).otherwise(F.col("value").cast("decimal(18,2)"))
    return e.select("event_id", "ts", "user_id", "event_type", k.alias("tokens"), cost.cast("decimal(18,2)").alias("cost"), (k % 4).alias("platform"), F.to_date("ts").alias("day"))


def _sum(c, name):
    return F.sum(c).cast("double").alias(name)


def a5_cost_by_model(spark, d):
    """Calls, tokens and cost of each model; calls with tokens that cost nothing."""
    none = (F.col("tokens") > 0) & (F.col("cost") == 0)
    return _calls(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), _sum("cost", "cost"), F.count_if(none).alias("untabulated"))


def a9_cost_by_dimension(spark, d):
    """Cost by source, account, platform, and day with platform, in one pass."""
    e = _calls(spark, d)
    sets = [["event_type"], ["user_id"], ["platform"], ["day", "platform"]]
    return e.groupingSets(sets, "event_type", "user_id", "platform", "day").agg(_sum("cost", "cost"), F.count(F.lit(1)).alias("calls"))


def a14_source_health(spark, d):
    """Runs of each source: all, failed, the share of good ones, the first and the last."""
    bad = F.count_if(F.col("value") > 150)
    return events(spark, d).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("runs"), bad.alias("failed"), F.round(1 - bad / F.count(F.lit(1)), 6).alias("success"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )


def a16_overview(spark, d):
    """Counters of several tables in one row."""
    e = events(spark, d).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(_k() == 0).alias("pending"))
    m = messages(spark, d).agg(F.count_if(F.col("relevant").isNull()).alias("unmarked"), F.count_if(F.col("blocked")).alias("blocked"))
    o = transactions(spark, d).agg(F.count_if(F.col("status") == "P").alias("open_orders"))
    return e.crossJoin(m).crossJoin(o)  # one row each


def a17_alerts(spark, d):
    """Users whose last event failed, users long unseen, types with a backlog; the gravest first."""
    e = events(spark, d)
    last = latest.first_per_key(e, ["user_id"], [F.desc("ts"), F.desc("event_id")])
    failed = last.where("event_type = 'error'").select(F.lit(1).alias("severity"), F.lit("failed").alias("alert"), F.col("user_id").cast("string").alias("subject"))
    stale = last.where(F.col("ts") < F.expr(f"TIMESTAMP_NTZ'{NOW}' - INTERVAL 36 HOURS")).select(F.lit(2).alias("severity"), F.lit("stale").alias("alert"), F.col("user_id").cast("string").alias("subject"))
    backlog = e.groupBy("event_type").agg(F.count_if(_k() < 20).alias("n")).where("n >= 10").select(F.lit(3).alias("severity"), F.lit("backlog").alias("alert"), F.col("event_type").alias("subject"))
    rows = ingest.numbered(failed.unionByName(stale).unionByName(backlog), ["severity"], ["subject"])
    return rows.withColumn("place", (F.col("place") + 1).cast("int"))


def a25_mark_mining(spark, d):
    """Marks by sender and language, the two languages most marked relevant of each sender."""
    rows = messages(spark, d).where("relevant IS NOT NULL").groupBy("sender", "lang").agg(F.count_if("relevant").alias("relevant"), F.count_if(~F.col("relevant")).alias("other"))
    return latest.first_per_key(rows, ["sender"], [F.desc("relevant"), F.col("lang")], 2).select("sender", "lang", "relevant", "other")


def a27_activity(spark, d):
    """Events in all, by type, and the twenty most active users."""
    e = events(spark, d)
    n = F.count(F.lit(1)).alias("n")
    users = latest.first_per_key(e.groupBy(F.col("user_id").cast("string").alias("name")).agg(n).withColumn("kind", F.lit("user")), ["kind"], [F.desc("n"), F.col("name")], 20)
    parts = [e.agg(n).select(F.lit("all").alias("kind"), F.lit("").alias("name"), "n"), e.groupBy(F.col("event_type").alias("name")).agg(n).select(F.lit("type").alias("kind"), "name", "n")]
    return parts[0].unionByName(parts[1]).unionByName(users.select("kind", "name", "n"))


def a33_spending(spark, d):
    """Spending by category, the ten largest customers, statuses by use."""
    t = transactions(spark, d)
    total, n = F.sum("amount").cast("double").alias("total"), F.count(F.lit(1)).alias("n")
    by = lambda kind, name: t.groupBy(F.col(name).cast("string").alias("name")).agg(total, n).select(F.lit(kind).alias("kind"), "name", "total", "n")
    top = latest.first_per_key(by("customer", "customer"), ["kind"], [F.desc("total"), F.col("name")], 10).select("kind", "name", "total", "n")
    return by("category", "priority").unionByName(top).unionByName(by("status", "status"))


def a41_cost_by_source(spark, d):
    """Cost by source; calls of none have a label of their own."""
    source = F.coalesce(F.when(F.col("user_id") % 5 > 0, F.col("user_id").cast("string")), F.lit("(none)"))
    return _calls(spark, d).groupBy(source.alias("source")).agg(_sum("cost", "cost"), F.count(F.lit(1)).alias("calls"))


def a47_review_queue(spark, d):
    """The twenty-five longest messages without a mark: a list of so many is what it is for."""
    return messages(spark, d).where("relevant IS NULL").orderBy(F.desc("n_chars"), "doc_id").limit(25).select("doc_id", "sender", "n_chars")


def n2_page(spark, d):
    """The third page of ten purchases with the number of all: counted apart, so that pages need no window."""
    rows = events(spark, d).where("event_type = 'purchase'")
    page = rows.orderBy(F.desc("ts"), F.desc("event_id")).offset(20).limit(10)
    return page.select("event_id", "user_id").crossJoin(rows.agg(F.count(F.lit(1)).alias("total")))  # one row


def p4_own_or_shared(spark, d):
    """Rows of one user and those of nobody."""
    return events(spark, d).withColumn("owner", F.when(F.col("user_id") % 3 > 0, F.col("user_id"))).where("owner = 4 OR owner IS NULL").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def optional(**given):
    """A condition of equalities; those without a value hold everywhere."""
    found = F.lit(True)
    for name, value in given.items():
        if value is not None:
            found &= F.col(name) == F.lit(value)
    return found


def p5_optional(spark, d):
    return events(spark, d).where(optional(event_type="click", user_id=None)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def p10_stale_runs(spark, d):
    """Running ones that began over thirty minutes ago."""
    started = F.expr(f"timestampdiff(MINUTE, ts, TIMESTAMP_NTZ'{NOW}')")
    return events(spark, d).select("event_id", ((F.col("event_type") == "signup") & (started > 30)).alias("stale"))


def p12_previews(spark, d):
    """Sender, language and text as one line, cut at forty characters."""
    line = F.concat_ws(" | ", "source", "lang", F.regexp_replace("text", "[\\r\\n]+", " "))
    return table(spark, d, "documents").select("doc_id", F.substring(line, 1, 40).alias("preview"))


def p15_active(spark, d):
    """Notices neither read nor expired."""
    active = (F.col("event_type") != "view") & (F.expr("ts + INTERVAL 7 DAYS") > F.expr(f"TIMESTAMP_NTZ'{NOW}'"))
    return events(spark, d).where(active).select("event_id")


def j5_handled(spark, d):
    """Users: events that were handled, either large or followed by a purchase of the user."""
    e = events(spark, d)
    bought = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("until"))
    rows = e.join(bought, "user_id", "left").withColumn("handled", (F.col("value") > 100) | F.coalesce(F.col("until") > F.col("ts"), F.lit(False)))
    return rows.groupBy("user_id").agg(F.count_if("handled").alias("handled"), F.count(F.lit(1)).alias("n"))


def j17_first_series(spark, d):
    """Each customer's first urgent order, beside their number of orders."""
    t = transactions(spark, d)
    return t.groupBy("customer").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.when(F.col("priority") == "1-URGENT", F.col("id")), F.when(F.col("priority") == "1-URGENT", F.struct("at", "id"))).alias("first_urgent"))


def j18_identifiers(spark, d):
    """Nations with the keys of their suppliers in order; none for some."""
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_join(F.array_sort(F.collect_list("s_suppkey")), ",").alias("keys"))
    return table(spark, d, "nation").join(s, "n_nationkey", "left").select("n_name", F.coalesce("keys", F.lit("")).alias("keys"))


def j20_both_ways(spark, d):
    """Each user's neighbours in a list of pairs, whichever side they stand on."""
    pairs = events(spark, d).where("event_type = 'click'").select(F.col("user_id").alias("a"), (_k() % 15).alias("b")).distinct()
    return pairs.select(F.col("a").alias("one"), F.col("b").alias("other")).unionByName(pairs.where("a <> b").select(F.col("b").alias("one"), F.col("a").alias("other"))).distinct()


def j22_frontier(spark, d):
    """The next target of each lot: the place in its list that its frontier names."""
    lots = ingest.numbered(transactions(spark, d).select("customer", "id", "status"), ["customer"], ["id"])
    return lots.where(F.col("place") == F.col("customer") % 4).select("customer", "id", "status")


def j23_samples(spark, d):
    """The three largest values of each user, as one string."""
    few = latest.first_per_key(events(spark, d), ["user_id"], [F.desc("value"), F.col("event_id")], 3)
    return few.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("sample"))


def j24_directed(spark, d):
    """The other end of each event by its type: a customer of a purchase, a supplier else."""
    e, k = events(spark, d), _k()
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    rows = e.withColumn("k", k)
    got = rows.where("event_type = 'purchase'").join(c, "k", "left").unionByName(rows.where("event_type <> 'purchase'").join(s, "k", "left"))
    return got.select("event_id", "name")


def w4_gated(spark, d):
    """Messages past the gate: those of some kinds at once, others by their mark, else their verdict."""
    m = messages(spark, d)
    mark, verdict = F.when(F.col("doc_id") % 2 == 0, F.col("relevant")), ~F.col("blocked")
    return m.select("doc_id", ((F.col("sender") == "web") | F.coalesce(mark, verdict, F.lit(False))).alias("passes"))


def w8_targets(spark, d):
    """What to process again: some users' failures of a span, the newest first, forty at most, as asked for."""
    rows = events(spark, d).where("user_id IN (1, 2, 3, 4, 5) AND event_type = 'error' AND ts >= TIMESTAMP_NTZ'2024-01-05' AND ts < TIMESTAMP_NTZ'2024-01-25'")
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(40).select("event_id", "user_id")


def w10_next_lot(spark, d):
    """The next five targets of each customer's lot from its frontier, with their places."""
    lots = ingest.numbered(transactions(spark, d).select("customer", "id"), ["customer"], ["id"])
    ahead = (F.col("place") - F.col("customer") % 7).cast("int")
    return lots.withColumn("place", ahead).where(F.col("place").between(0, 4)).select("customer", "place", "id")


def w14_modules(spark, d):
    """How many events each module reads, by their type."""
    m = spark.createDataFrame(MODULES, "module string, kinds string, needs string").select("module", F.explode(F.split("kinds", ",")).alias("event_type"))
    return events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(m), "event_type").groupBy("module").agg(F.sum("n").alias("n"))  # five modules


def w19_attributed(spark, d):
    """How many facts rest on each source id."""
    facts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("sources"))
    return facts.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("facts"))


def i12_claimed(spark, d):
    """Closed windows that no swept range covers yet."""
    week = F.to_date(F.date_trunc("week", F.col("ts")))
    swept = events(spark, d).where("event_type = 'signup'").select("user_id", week.alias("start")).distinct()
    ranges = swept.groupBy("user_id").agg(F.min("start").alias("low"), F.date_add(F.max("start"), 7).alias("high"))
    windows = events(spark, d).where("event_type = 'click'").select("user_id", week.alias("start")).distinct().where("date_add(start, 7) <= DATE'2024-01-29'")
    return windows.join(ranges, (windows["user_id"] == ranges["user_id"]) & (F.col("start") >= F.col("low")) & (F.date_add("start", 7) <= F.col("high")), "left_anti")


def x3_marks(spark, d):
    """The last mark of each user and type; cleared ones go."""
    last = latest.first_per_key(events(spark, d), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return last.where(_k() % 3 > 0).select("user_id", "event_type", (_k() % 3 == 1).alias("mark"), "event_id")


def x8_candidates(spark, d):
    """Scores of this round; the status is that of the round before, if there was one."""
    e = events(spark, d)
    n = lambda rows: rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("score"))
    before = n(e.where("ts < TIMESTAMP_NTZ'2024-01-10' AND event_type = 'error'")).select("user_id", F.when(F.col("score") % 2 == 0, "accepted").otherwise("dismissed").alias("status"))
    return n(e.where("ts >= TIMESTAMP_NTZ'2024-01-10'")).join(before, "user_id", "left").select("user_id", "score", F.coalesce("status", F.lit("open")).alias("status"))


def x10_lifecycle(spark, d):
    """Each user's runs: a signup begins one, a purchase ends it well, an error badly; none left open by another."""
    rows = events(spark, d).where("event_type IN ('signup', 'purchase', 'error')")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    follow = F.lead("event_type").over(w)
    runs = rows.withColumn("next", follow).where("event_type = 'signup'")
    state = F.when(F.col("next") == "purchase", "ok").when(F.col("next") == "error", "failed").when(F.col("next") == "signup", "aborted").otherwise("running")
    return runs.select("event_id", "user_id", state.alias("state"))


def x30_message_detail(spark, d):
    """Each message with its marks and the page of its number, if any."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return messages(spark, d).join(pages, "doc_id", "left").select("doc_id", "sender", "relevant", "blocked", "url")


def x32_positions(spark, d):
    """The last position of each user within a half-open span."""
    rows = events(spark, d).where("ts >= TIMESTAMP_NTZ'2024-01-03' AND ts < TIMESTAMP_NTZ'2024-01-20'")
    return rows.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count(F.lit(1)).alias("n"))


_K = "coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0)"
_CALLS = f"""SELECT event_id, ts, user_id, event_type, {_K} AS tokens, CASE WHEN event_type = 'view' THEN 0 ELSE CAST(value AS DECIMAL(18,2)) END AS cost,
    {_K} % 4 AS platform, CAST(ts AS DATE) AS day FROM events"""
_MARKED = "SELECT d.doc_id, source AS sender, lang, n_chars, quality = 1 AS relevant, toxic = 1 AS blocked FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
_LAST = "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
_AT = f"TIMESTAMP '{NOW}'"

SQL = {
    "a5_cost_by_model": f"""SELECT event_type, count(*) AS calls, sum(tokens) AS tokens, CAST(sum(cost) AS DOUBLE) AS cost, count(*) FILTER (tokens > 0 AND cost = 0) AS untabulated
        FROM ({_CALLS}) GROUP BY 1""",
    "a9_cost_by_dimension": f"""SELECT event_type, user_id, platform, day, CAST(sum(cost) AS DOUBLE) AS cost, count(*) AS calls FROM ({_CALLS})
        GROUP BY GROUPING SETS ((event_type), (user_id), (platform), (day, platform))""",
    "a14_source_health": """SELECT event_type, count(*) AS runs, count(*) FILTER (value > 150) AS failed, round(1 - count(*) FILTER (value > 150) / count(*), 6) AS success,
        min(ts) AS "first", max(ts) AS "last" FROM events GROUP BY 1""",
    "a16_overview": f"""SELECT (SELECT count(*) FROM events WHERE event_type = 'error') AS errors, (SELECT count(*) FROM events WHERE {_K} = 0) AS pending,
        (SELECT count(*) FROM ({_MARKED}) WHERE relevant IS NULL) AS unmarked, (SELECT count(*) FROM ({_MARKED}) WHERE blocked) AS blocked,
        (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS open_orders""",
    "a17_alerts": f"""WITH a AS (SELECT 1 AS severity, 'failed' AS alert, CAST(user_id AS VARCHAR) AS subject FROM ({_LAST}) WHERE event_type = 'error'
        UNION ALL SELECT 2, 'stale', CAST(user_id AS VARCHAR) FROM ({_LAST}) WHERE ts < {_AT} - INTERVAL 36 HOUR
        UNION ALL SELECT 3, 'backlog', event_type FROM events WHERE {_K} < 20 GROUP BY event_type HAVING count(*) >= 10)
        SELECT severity, alert, subject, row_number() OVER (PARTITION BY severity ORDER BY subject) AS place FROM a""",
    "a25_mark_mining": f"""SELECT sender, lang, relevant, other FROM (SELECT sender, lang, count(*) FILTER (relevant) AS relevant, count(*) FILTER (NOT relevant) AS other
        FROM ({_MARKED}) WHERE relevant IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY sender ORDER BY relevant DESC, lang) <= 2""",
    "a27_activity": """SELECT 'all' AS kind, '' AS name, count(*) AS n FROM events UNION ALL SELECT 'type', event_type, count(*) FROM events GROUP BY 2
        UNION ALL SELECT 'user', name, n FROM (SELECT CAST(user_id AS VARCHAR) AS name, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, name LIMIT 20)""",
    "a33_spending": """WITH t AS (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders)
        SELECT 'category' AS kind, o_orderpriority AS name, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS n FROM t GROUP BY 2
        UNION ALL SELECT 'status', o_orderstatus, CAST(sum(amount) AS DOUBLE), count(*) FROM t GROUP BY 2
        UNION ALL SELECT * FROM (SELECT 'customer', CAST(o_custkey AS VARCHAR) AS name, CAST(sum(amount) AS DOUBLE) AS total, count(*) FROM t GROUP BY 2 ORDER BY total DESC, name LIMIT 10)""",
    "a41_cost_by_source": f"""SELECT coalesce(CASE WHEN user_id % 5 > 0 THEN CAST(user_id AS VARCHAR) END, '(none)') AS source, CAST(sum(cost) AS DOUBLE) AS cost, count(*) AS calls
        FROM ({_CALLS}) GROUP BY 1""",
    "a47_review_queue": f"SELECT doc_id, sender, n_chars FROM ({_MARKED}) WHERE relevant IS NULL ORDER BY n_chars DESC, doc_id LIMIT 25",
    "n2_page": """SELECT event_id, user_id, total FROM (SELECT event_id, user_id, count(*) OVER () AS total, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS r FROM events
        WHERE event_type = 'purchase') WHERE r BETWEEN 21 AND 30""",
    "p4_own_or_shared": "SELECT event_type, count(*) AS n FROM events WHERE (user_id % 3 > 0 AND user_id = 4) OR user_id % 3 = 0 GROUP BY 1",
    "p5_optional": "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1",
    "p10_stale_runs": f"SELECT event_id, event_type = 'signup' AND (epoch_us({_AT}) - epoch_us(ts)) // 60000000 > 30 AS stale FROM events",
    "p12_previews": r"SELECT doc_id, substr(concat_ws(' | ', source, lang, regexp_replace(text, '[\r\n]+', ' ', 'g')), 1, 40) AS preview FROM documents",
    "p15_active": f"SELECT event_id FROM events WHERE event_type <> 'view' AND ts + INTERVAL 7 DAY > {_AT}",
    "j5_handled": """SELECT user_id, count(*) FILTER (value > 100 OR EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts > e.ts)) AS handled,
        count(*) AS n FROM events e GROUP BY 1""",
    "j17_first_series": """SELECT c AS customer, (SELECT count(*) FROM orders WHERE o_custkey = c) AS n, (SELECT arg_min(o_orderkey, (o_orderdate, o_orderkey)) FROM orders
        WHERE o_custkey = c AND o_orderpriority = '1-URGENT') AS first_urgent FROM (SELECT DISTINCT o_custkey AS c FROM orders)""",
    "j18_identifiers": """SELECT n_name, coalesce((SELECT string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), '') AS keys FROM nation""",
    "j20_both_ways": f"""WITH p AS (SELECT DISTINCT user_id AS a, {_K} % 15 AS b FROM events WHERE event_type = 'click') SELECT a AS one, b AS other FROM p UNION SELECT b, a FROM p""",
    "j22_frontier": """SELECT o_custkey AS customer, o_orderkey AS id, o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = o_custkey % 4 + 1""",
    "j23_samples": """SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS sample FROM (SELECT * FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3) GROUP BY 1""",
    "j24_directed": f"""SELECT event_id, CASE WHEN event_type = 'purchase' THEN c_name ELSE s_name END AS name FROM (SELECT *, {_K} AS k FROM events)
        LEFT JOIN customer ON event_type = 'purchase' AND c_custkey = k LEFT JOIN supplier ON event_type <> 'purchase' AND s_suppkey = k""",
    "w4_gated": f"SELECT doc_id, sender = 'web' OR coalesce(CASE WHEN doc_id % 2 = 0 THEN relevant END, NOT blocked, false) AS passes FROM ({_MARKED})",
    "w8_targets": """SELECT event_id, user_id FROM events WHERE user_id BETWEEN 1 AND 5 AND event_type = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'
        ORDER BY ts DESC, event_id DESC LIMIT 40""",
    "w10_next_lot": """SELECT customer, CAST(r - o - 1 AS INTEGER) AS place, id FROM (SELECT o_custkey AS customer, o_orderkey AS id, o_custkey % 7 AS o,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r BETWEEN o + 1 AND o + 5""",
    "w14_modules": "SELECT module, count(*) AS n FROM (VALUES " + ", ".join(f"('{m}', '{k}')" for m, kinds, _ in MODULES for k in kinds.split(",")) + ") v(module, kind) JOIN events ON event_type = kind GROUP BY 1",
    "w19_attributed": "SELECT l_suppkey AS source, count(DISTINCT l_orderkey) AS facts FROM lineitem GROUP BY 1",
    "i12_claimed": """WITH s AS (SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS start, event_type FROM events), r AS (SELECT user_id, min(start) AS low, max(start) + 7 AS high FROM s
        WHERE event_type = 'signup' GROUP BY 1) SELECT DISTINCT user_id, start FROM s WHERE event_type = 'click' AND start + 7 <= DATE '2024-01-29'
        AND NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = s.user_id AND s.start >= low AND s.start + 7 <= high)""",
    "x3_marks": f"""SELECT user_id, event_type, k % 3 = 1 AS mark, event_id FROM (SELECT *, {_K} AS k FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1) WHERE k % 3 > 0""",
    "x8_candidates": """WITH b AS (SELECT user_id, CASE WHEN count(*) % 2 = 0 THEN 'accepted' ELSE 'dismissed' END AS status FROM events
        WHERE ts < TIMESTAMP '2024-01-10' AND event_type = 'error' GROUP BY 1)
        SELECT user_id, score, coalesce(status, 'open') AS status FROM (SELECT user_id, count(*) AS score FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1) LEFT JOIN b USING (user_id)""",
    "x10_lifecycle": """SELECT event_id, user_id, CASE nxt WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'aborted' ELSE 'running' END AS state FROM (
        SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events WHERE event_type IN ('signup', 'purchase', 'error')) WHERE event_type = 'signup'""",
    "x30_message_detail": f"SELECT m.doc_id, sender, relevant, blocked, url FROM ({_MARKED}) m LEFT JOIN pages ON page_id = m.doc_id",
    "x32_positions": """SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1""",
}
QUERIES = {name: globals()[name] for name in SQL}
