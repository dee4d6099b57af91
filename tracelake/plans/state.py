"""Queries over kept state: decisions, dimensions, provenance, membership, work that is left."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.operators import hierarchy, ingest, latest
from tracelake.plans.agenda import _E as _ENTRIES
from tracelake.plans.agenda import entries
from tracelake.plans.upkeep import _K, _MARKED, _k
from tracelake.sources.tables import events, messages, table, transactions

DAY = "DATE'1998-01-01'"
#: Edges that one task tells apart, about: tasks grow in number, not in memory.
ROWS_OF_A_TASK = 500_000
#: Window sizes of the kinds of messages that have one of their own.
SIZES = {"view": 40, "click": 25, "error": 10}


def _n(name="n"):
    return F.count(F.lit(1)).alias(name)


def p13_current(spark, d):
    """Entries that aren't over on a day, by their last day."""
    return entries(spark, d).where(F.greatest(F.coalesce("ends_on", "starts_on"), "starts_on") >= F.expr(DAY)).select("id")


def p14_places(spark, d):
    """Places that can be looked up: not blank, no address of the web."""
    place = F.when(F.col("id") % 28 == 0, "https://meet.example/x").otherwise(F.col("location"))
    return entries(spark, d).select("id", ((F.trim(place) != "") & ~F.contains(place, F.lit("://"))).alias("usable"))


def j21_activity(spark, d):
    """Customers with the numbers of their orders and events, each counted before its join."""
    o = transactions(spark, d).groupBy(F.col("customer").alias("c_custkey")).agg(_n("orders"))
    e = events(spark, d).groupBy(F.col("user_id").alias("c_custkey")).agg(_n("events"))
    rows = table(spark, d, "customer").join(o, "c_custkey", "left").join(e, "c_custkey", "left")
    return rows.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("events", F.lit(0)).alias("events"))


def i14_tiers(spark, d):
    """Tiers of messages that have no mark: a sender's own one, else by length."""
    own = F.when(F.col("sender") == "web", "bulk").when(F.col("sender") == "books", "individual")
    rule = F.when(F.col("n_chars") > 3000, "newsletter").when(F.col("n_chars") > 500, "list").otherwise("individual")
    return messages(spark, d).where("relevant IS NULL").select("doc_id", F.coalesce(own, rule).alias("tier"))


def f20_cursors(spark, d):
    """Each user's last event of every type as one line."""
    last = events(spark, d).groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("id"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("event_type", "id"))), lambda x: F.concat(x["event_type"], F.lit("="), x["id"].cast("string")))
    return last.groupBy("user_id").agg(F.array_join(parts, ", ").alias("summary"))


def f28_labels(spark, d):
    """Labels of orders by three axes: settled or not, urgent or not, large or not."""
    t = transactions(spark, d)
    label = F.when(F.col("status") == "F", "settled").when(F.col("priority").isin("1-URGENT", "2-HIGH"), "urgent").when(F.col("amount") > 200_000, "large").otherwise("plain")
    return t.groupBy(label.alias("label")).agg(_n())


def f30_scoped(spark, d):
    """Of each order's lines those of odd suppliers, as one string."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("x"))
    some = F.transform(F.filter("x", lambda i: i["l_suppkey"] % 2 == 1), lambda i: i["l_suppkey"].cast("string"))
    return lines.select("l_orderkey", F.array_join(some, ",").alias("suppliers"))


def r1_vertices(spark, d):
    """Every vertex with its kind and label."""
    of = lambda t, k, label: table(spark, d, t).select(F.lit(t).alias("kind"), F.col(k).cast("long").alias("id"), F.col(label).alias("label"))
    rows = of("customer", "c_custkey", "c_name")
    for x in (("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"), ("orders", "o_orderkey", "o_orderpriority"), ("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name")):
        rows = rows.unionByName(of(*x))
    return rows


def w5_worked(spark, d):
    """Messages whose tier is worked on: all that passed a gate, of others those of the individual tier; without files that are still open."""
    m = messages(spark, d)
    gated, tier, is_open = F.col("sender") == "books", F.when(F.col("n_chars") > 800, "list").otherwise("individual"), F.col("doc_id") % 4 == 0
    return m.select("doc_id", ((gated | (tier == "individual")) & ~is_open).alias("worked"))


def x4_overrides(spark, d):
    """Tiers of senders as last set; one set to nothing is cleared."""
    last = latest.first_per_key(messages(spark, d), ["sender", "lang"], [F.desc("doc_id")])
    return last.where("n_chars % 5 > 0").select("sender", "lang", (F.col("n_chars") % 5).alias("tier"))


def r2_provenance(spark, d):
    """How many orders each vertex rests on: customers directly, parts and suppliers by lines."""
    lines = table(spark, d, "lineitem")
    of = lambda kind, rows: rows.select(F.lit(kind).alias("kind"), F.col("v").alias("id"), F.col("o").alias("order")).distinct()
    rows = of("customer", transactions(spark, d).select(F.col("customer").alias("v"), F.col("id").alias("o")))
    for kind, c in (("part", "l_partkey"), ("supplier", "l_suppkey")):
        rows = rows.unionByName(of(kind, lines.select(F.col(c).alias("v"), F.col("l_orderkey").alias("o"))))
    return rows.groupBy("kind", "id").agg(_n("orders"))


def r6_real_edges(spark, d):
    """Edges that the tables themselves say, from each of their producers."""
    edge = lambda t, kind, a, b: table(spark, d, t).select(F.lit(kind).alias("kind"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    rows = edge("customer", "lives_in", "c_custkey", "c_nationkey")
    for x in (("supplier", "sits_in", "s_suppkey", "s_nationkey"), ("orders", "ordered_by", "o_orderkey", "o_custkey"), ("nation", "part_of", "n_nationkey", "n_regionkey"), ("lineitem", "delivers", "l_suppkey", "l_partkey")):
        rows = rows.unionByName(edge(*x))
    parts = rows.count() // ROWS_OF_A_TASK + 1
    ends = rows.repartition(parts, "kind", "a", "b").distinct().select("kind", F.posexplode(F.array("a", "b")).alias("side", "end"))
    met = ends.repartition(2 * parts, "kind", "side", "end").groupBy("kind", "side", "end").agg(_n("edges"))
    of = lambda side, x: F.when(F.col("side") == side, x)
    return met.groupBy("kind").agg(F.sum(of(0, F.col("edges"))).alias("n"), F.count(of(0, F.col("end"))).alias("from"), F.count(of(1, F.col("end"))).alias("to"))


def r9_overrides(spark, d):
    """The last decision on each user and type; a person's beats any rule's."""
    rows = events(spark, d).withColumns({"human": _k() >= 80, "verdict": F.when(_k() % 2 == 0, "confirmed").otherwise("rejected")})
    last = latest.first_per_key(rows, ["user_id", "event_type"], [F.desc("human"), F.desc("ts"), F.desc("event_id")])
    return last.select("user_id", "event_type", "human", "verdict")


def r18_members(spark, d):
    """Memberships to add and to drop: of suppliers in good standing against those that are stored."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("group"), "s_acctbal")
    want, have = s.where("s_acctbal > 1000").select("id", "group"), s.where("id % 3 > 0").select("id", (F.col("group") - F.when(F.col("id") % 20 == 1, 1).otherwise(0)).alias("group"))
    return want.join(have, ["id", "group"], "left_anti").withColumn("change", F.lit("add")).unionByName(have.join(want, ["id", "group"], "left_anti").withColumn("change", F.lit("drop")))


def r19_pruned(spark, d):
    """Edges between parts and suppliers whose ends there still are."""
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    parts = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("a"))
    suppliers = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("b"))
    return e.join(parts, "a", "left_semi").join(suppliers, "b", "left_semi").select("a", "b")


def r22_decisions(spark, d):
    """Decisions that differ in their evidence from the one before; others are skipped."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = events(spark, d).withColumn("evidence", _k() % 3)
    return rows.withColumn("before", F.lag("evidence").over(w)).where("before IS NULL OR before <> evidence").select("event_id", "user_id", "event_type", "evidence")


def r23_focus(spark, d):
    """The suppliers of an order, those met one step on, and the edges between all these."""
    e = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    seeds = e.where("l_orderkey = 7").select(F.col("l_suppkey").alias("id"))
    met = e.join(e.join(seeds, F.col("l_suppkey") == F.col("id"), "left_semi").select("l_orderkey").distinct(), "l_orderkey").select(F.col("l_suppkey").alias("id"))
    inside = seeds.union(met).distinct()
    few = e.join(inside, F.col("l_suppkey") == F.col("id"), "left_semi")
    a, b = few.select("l_orderkey", F.col("l_suppkey").alias("a")), few.select("l_orderkey", F.col("l_suppkey").alias("b"))
    return a.join(b, "l_orderkey").where("a < b").groupBy("a", "b").agg(_n())


def r25_collapsed(spark, d):
    """Edges between suppliers and parts after each supplier went into its outermost folded ancestor."""
    parents = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") > 0, F.floor(F.col("s_suppkey") / 3)).alias("parent"))
    folded = hierarchy.ancestors(parents).where("ancestor IN (2, 4, 7, 14)").groupBy("id").agg(F.max_by("ancestor", "steps").alias("into"))
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), "l_partkey")
    return e.join(folded, "id", "left").groupBy(F.coalesce("into", "id").alias("id")).agg(_n("edges"), F.count_distinct("l_partkey").alias("parts"))


def r26_channels(spark, d):
    """The dimension of senders: their last language and the number of messages."""
    m = messages(spark, d)
    return m.groupBy("sender").agg(F.max_by("lang", "doc_id").alias("lang"), F.max("doc_id").alias("last_id"), _n())


def e4_neighbourhood(spark, d):
    """Orders that new ones could match: of the span of the new ones, a week wider on both sides."""
    t = transactions(spark, d)
    span = t.where("id % 97 = 3 AND at >= TIMESTAMP_NTZ'1998-01-01' AND at < TIMESTAMP_NTZ'1998-03-01'").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    near = (F.col("at") >= F.expr("low - INTERVAL 7 DAYS")) & (F.col("at") <= F.expr("high + INTERVAL 7 DAYS"))
    return t.join(F.broadcast(span), near).select("id")  # one row


def e5_outcomes(spark, d):
    """What became of each order: an echo of an open one, a duplicate of an earlier one of its day, or unique."""
    t = transactions(spark, d)
    w = Window.partitionBy("customer", "at").orderBy("id")
    outcome = F.when(F.col("status") == "P", "pending").when(F.row_number().over(w) > 1, "duplicate").otherwise("unique")
    return t.select("id", outcome.alias("outcome"))


def s18_since_cursor(spark, d):
    """Rows since a day before each user's cursor, which is the last purchase of the first ten days."""
    e = events(spark, d)
    cursor = e.where("event_type = 'purchase' AND ts < TIMESTAMP_NTZ'2024-01-11'").groupBy("user_id").agg(F.max("ts").alias("cursor"))
    return e.join(cursor, "user_id").where("ts >= cursor - INTERVAL 1 DAY").groupBy("user_id").agg(_n())


def s29_unstored(spark, d):
    """Pages that declare linked files of which none is stored."""
    n = F.regexp_count("html", F.lit("<a href"))
    stored = table(spark, d, "labels").select(F.col("doc_id").alias("page_id"))
    return table(spark, d, "pages").select("page_id", n.alias("declared")).where("declared > 0").join(stored, "page_id", "left_anti")


def w11_window_sizes(spark, d):
    """Each user's window: the smallest of the kinds there are, else fifty."""
    size = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in SIZES.items()], F.lit(50))
    return events(spark, d).where("value > 100").groupBy("user_id").agg(F.min(size).alias("size"))


def w23_batch_of(spark, d):
    """The other turns of the window that a conversation's third turn falls into."""
    turns = table(spark, d, "conversations").select("conv_id", "turn")
    windows = ingest.count_windows(turns, "conv_id", ["turn"], 3).select("conv_id", "turn", "window_no")
    third = windows.where("turn = 3").select("conv_id", "window_no")
    return windows.join(third, ["conv_id", "window_no"]).select("conv_id", "turn", "window_no")


def w24_orphans(spark, d):
    """Summaries that no link is left to after those of most messages are written anew."""
    links = table(spark, d, "lineitem").select(F.col("l_partkey").alias("summary"), F.col("l_orderkey").alias("message")).distinct()
    left = links.where("message % 40 = 0")
    return links.select("summary").distinct().join(left, "summary", "left_anti")


def x2_verdicts(spark, d):
    """Verdicts are written once; a person's, or a later one after a person cleared it, counts."""
    rows = events(spark, d).withColumn("manual", _k() > 90)
    first = latest.first_per_key(rows, ["user_id", "event_type"], [F.desc("manual"), F.col("ts"), F.col("event_id")])
    return first.select("user_id", "event_type", "event_id", "manual")


def x6_suggestions(spark, d):
    """Proposals without those that say the same as an earlier one; decided ones don't count."""
    rows = table(spark, d, "part").select("p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("text"), (F.col("p_size") % 2 == 0).alias("open"))
    return rows.where("open").groupBy("text").agg(F.min("p_partkey").alias("p_partkey"), _n("said"))


def x16_dirty(spark, d):
    """Users with something newer than what was last worked on."""
    e = events(spark, d)
    done = e.where("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("done"))
    last = e.groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.join(done, "user_id", "left").select("user_id", F.coalesce(F.col("last") > F.col("done"), F.lit(True)).alias("dirty"))


def x18_blobs(spark, d):
    """The ten orders with most lines, and of each its three largest: lists of so many."""
    lines = table(spark, d, "lineitem")
    top = lines.groupBy("l_orderkey").agg(_n("lines")).orderBy(F.desc("lines"), "l_orderkey").limit(10)
    few = latest.first_per_key(lines.join(F.broadcast(top), "l_orderkey"), ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")], 3)  # ten rows
    return few.select("l_orderkey", "lines", "l_linenumber", "l_extendedprice")


def x28_accounts(spark, d):
    """The health of each account from its last run."""
    last = latest.first_per_key(events(spark, d), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    health = F.when(F.col("event_type") == "error", "failing").when(F.col("value") < 20, "idle").otherwise("ok")
    return last.select("user_id", health.alias("health"))


def x31_extractions(spark, d):
    """What each of three modules drew from some messages: facts whose sources overlap with them."""
    lines = table(spark, d, "lineitem")
    wanted = F.array(*[F.lit(i).cast("long") for i in (1, 5, 9)])
    facts = lambda key, name: lines.groupBy(F.col(key).alias("id")).agg(F.collect_set("l_suppkey").alias("s")).where(F.arrays_overlap("s", wanted)).select(F.lit(name).alias("module"), "id")
    return facts("l_orderkey", "orders").unionByName(facts("l_partkey", "parts")).groupBy("module").agg(_n(), F.min("id").alias("first_id"))


_UP = "SELECT s_suppkey AS id, CASE WHEN s_suppkey > 0 THEN s_suppkey // 3 END AS parent FROM supplier"
_T = "SELECT o_orderkey AS id, o_custkey AS customer, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderdate AS \"at\", o_orderpriority AS priority FROM orders"

SQL = {
    "p13_current": f"SELECT id FROM ({_ENTRIES}) WHERE greatest(coalesce(ends_on, starts_on), starts_on) >= {DAY}",
    "p14_places": f"""SELECT id, trim(p) <> '' AND NOT contains(p, '://') AS usable FROM (SELECT id, CASE WHEN id % 28 = 0 THEN 'https://meet.example/x' ELSE location END AS p FROM ({_ENTRIES}))""",
    "j21_activity": """SELECT c_custkey, count(DISTINCT o_orderkey) AS orders, count(DISTINCT event_id) AS events FROM customer LEFT JOIN orders ON o_custkey = c_custkey
        LEFT JOIN events ON user_id = c_custkey GROUP BY 1""",
    "i14_tiers": f"""SELECT doc_id, CASE WHEN sender = 'web' THEN 'bulk' WHEN sender = 'books' THEN 'individual' WHEN n_chars > 3000 THEN 'newsletter' WHEN n_chars > 500 THEN 'list' ELSE 'individual' END AS tier
        FROM ({_MARKED}) WHERE relevant IS NULL""",
    "f20_cursors": """SELECT user_id, string_agg(event_type || '=' || id, ', ' ORDER BY event_type) AS summary FROM (SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS id FROM events GROUP BY 1, 2) GROUP BY 1""",
    "f28_labels": f"""SELECT CASE WHEN status = 'F' THEN 'settled' WHEN priority IN ('1-URGENT', '2-HIGH') THEN 'urgent' WHEN amount > 200000 THEN 'large' ELSE 'plain' END AS label, count(*) AS n FROM ({_T}) GROUP BY 1""",
    "f30_scoped": """SELECT l_orderkey, coalesce(string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_linenumber, l_suppkey) FILTER (l_suppkey % 2 = 1), '') AS suppliers FROM lineitem GROUP BY 1""",
    "r1_vertices": """SELECT 'customer' AS kind, c_custkey AS id, c_name AS label FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL
        SELECT 'part', p_partkey, p_name FROM part UNION ALL SELECT 'orders', o_orderkey, o_orderpriority FROM orders UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation UNION ALL
        SELECT 'region', r_regionkey, r_name FROM region""",
    "w5_worked": f"SELECT doc_id, (sender = 'books' OR n_chars <= 800) AND doc_id % 4 <> 0 AS worked FROM ({_MARKED})",
    "x4_overrides": f"""SELECT sender, lang, n_chars % 5 AS tier FROM (SELECT * FROM ({_MARKED}) QUALIFY row_number() OVER (PARTITION BY sender, lang ORDER BY doc_id DESC) = 1) WHERE n_chars % 5 > 0""",
    "r2_provenance": """SELECT 'customer' AS kind, o_custkey AS id, count(DISTINCT o_orderkey) AS orders FROM orders GROUP BY 2 UNION ALL
        SELECT 'part', l_partkey, count(DISTINCT l_orderkey) FROM lineitem GROUP BY 2 UNION ALL SELECT 'supplier', l_suppkey, count(DISTINCT l_orderkey) FROM lineitem GROUP BY 2""",
    "r6_real_edges": """SELECT kind, count(*) AS n, count(DISTINCT a) AS "from", count(DISTINCT b) AS "to" FROM (SELECT 'lives_in' AS kind, c_custkey AS a, c_nationkey AS b FROM customer
        UNION SELECT 'sits_in', s_suppkey, s_nationkey FROM supplier UNION SELECT 'ordered_by', o_orderkey, o_custkey FROM orders UNION SELECT 'part_of', n_nationkey, n_regionkey FROM nation
        UNION SELECT 'delivers', l_suppkey, l_partkey FROM lineitem) GROUP BY 1""",
    "r9_overrides": f"""SELECT user_id, event_type, k >= 80 AS human, CASE WHEN k % 2 = 0 THEN 'confirmed' ELSE 'rejected' END AS verdict FROM (SELECT *, {_K} AS k FROM events)
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY k >= 80 DESC, ts DESC, event_id DESC) = 1""",
    "r18_members": """WITH w AS (SELECT s_suppkey AS id, s_nationkey AS "group" FROM supplier WHERE s_acctbal > 1000), h AS (SELECT s_suppkey, s_nationkey - CASE WHEN s_suppkey % 20 = 1 THEN 1 ELSE 0 END
        FROM supplier WHERE s_suppkey % 3 > 0) SELECT *, 'add' AS change FROM (FROM w EXCEPT FROM h) UNION ALL SELECT *, 'drop' FROM (FROM h EXCEPT FROM w)""",
    "r19_pruned": """SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size > 10 JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0""",
    "r22_decisions": f"""SELECT event_id, user_id, event_type, evidence FROM (SELECT *, {_K} % 3 AS evidence FROM events)
        QUALIFY coalesce(lag(evidence) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <> evidence, true)""",
    "r23_focus": """WITH e AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem), f AS (SELECT * FROM e), seeds AS (SELECT s FROM e WHERE o = 7),
        i AS (SELECT s FROM seeds UNION SELECT s FROM f WHERE o IN (SELECT o FROM f WHERE s IN (FROM seeds)))
        SELECT x.s AS a, y.s AS b, count(*) AS n FROM f x JOIN f y ON x.o = y.o AND x.s < y.s WHERE x.s IN (FROM i) AND y.s IN (FROM i) GROUP BY 1, 2""",
    "r25_collapsed": f"""WITH RECURSIVE p AS ({_UP}), t AS (SELECT id, id AS ancestor, 0 AS steps FROM p UNION ALL SELECT t.id, p.parent, steps + 1 FROM t JOIN p ON p.id = t.ancestor WHERE p.parent IS NOT NULL),
        f AS (SELECT id, arg_max(ancestor, steps) AS into_id FROM t WHERE ancestor IN (2, 4, 7, 14) GROUP BY 1)
        SELECT coalesce(into_id, l_suppkey) AS id, count(*) AS edges, count(DISTINCT l_partkey) AS parts FROM lineitem LEFT JOIN f ON f.id = l_suppkey GROUP BY 1""",
    "r26_channels": f"SELECT sender, arg_max(lang, doc_id) AS lang, max(doc_id) AS last_id, count(*) AS n FROM ({_MARKED}) GROUP BY 1",
    "e4_neighbourhood": f"""WITH s AS (SELECT min("at") AS low, max("at") AS high FROM ({_T}) WHERE id % 97 = 3 AND "at" >= TIMESTAMP '1998-01-01' AND "at" < TIMESTAMP '1998-03-01')
        SELECT id FROM ({_T}), s WHERE "at" >= low - INTERVAL 7 DAY AND "at" <= high + INTERVAL 7 DAY""",
    "e5_outcomes": f"""SELECT id, CASE WHEN status = 'P' THEN 'pending' WHEN row_number() OVER (PARTITION BY customer, "at" ORDER BY id) > 1 THEN 'duplicate' ELSE 'unique' END AS outcome FROM ({_T})""",
    "s18_since_cursor": """WITH c AS (SELECT user_id, max(ts) AS c FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-11' GROUP BY 1)
        SELECT user_id, count(*) AS n FROM events JOIN c USING (user_id) WHERE ts >= c - INTERVAL 1 DAY GROUP BY 1""",
    "s29_unstored": """SELECT page_id, declared FROM (SELECT page_id, (length(html) - length(replace(html, '<a href', ''))) // 7 AS declared FROM pages) WHERE declared > 0
        AND page_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""",
    "w11_window_sizes": """SELECT user_id, min(CASE event_type WHEN 'view' THEN 40 WHEN 'click' THEN 25 WHEN 'error' THEN 10 ELSE 50 END) AS size FROM events WHERE value > 100 GROUP BY 1""",
    "w23_batch_of": """WITH w AS (SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS window_no FROM conversations)
        SELECT w.* FROM w JOIN (SELECT conv_id, window_no FROM w WHERE turn = 3) t USING (conv_id, window_no)""",
    "w24_orphans": """SELECT l_partkey AS summary FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_orderkey % 40 = 0) = 0""",
    "x2_verdicts": f"""SELECT user_id, event_type, event_id, k > 90 AS manual FROM (SELECT *, {_K} AS k FROM events)
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY k > 90 DESC, ts, event_id) = 1""",
    "x6_suggestions": "SELECT lower(p_name || ' ' || p_brand) AS text, min(p_partkey) AS p_partkey, count(*) AS said FROM part WHERE p_size % 2 = 0 GROUP BY 1",
    "x16_dirty": """SELECT user_id, coalesce(max(ts) > max(ts) FILTER (event_type = 'view'), true) AS dirty FROM events GROUP BY 1""",
    "x18_blobs": """WITH t AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1 ORDER BY lines DESC, l_orderkey LIMIT 10)
        SELECT l_orderkey, lines, l_linenumber, l_extendedprice FROM lineitem JOIN t USING (l_orderkey) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) <= 3""",
    "x28_accounts": """SELECT user_id, CASE WHEN event_type = 'error' THEN 'failing' WHEN value < 20 THEN 'idle' ELSE 'ok' END AS health FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "x31_extractions": """SELECT module, count(*) AS n, min(id) AS first_id FROM (SELECT DISTINCT 'orders' AS module, l_orderkey AS id FROM lineitem WHERE l_suppkey IN (1, 5, 9)
        UNION SELECT 'parts', l_partkey FROM lineitem WHERE l_suppkey IN (1, 5, 9)) GROUP BY 1""",
}
QUERIES = {name: globals()[name] for name in SQL}
