"""Queries over stores: groups and clusters that are kept up to date change by change."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import calendar_sync, clusters, consolidate, senders
from tracelake.plans import finance
from tracelake.shared import new_path, written
from tracelake.sources.tables import events, table, transactions
from tracelake.store import Store

#: Days at which the orders so far are grouped; what comes between them is added.
BATCHES = ("1995-01-01", "1996-06-01", "1997-06-01", "2100-01-01")


def e10_incremental(spark, d):
    """Groups of duplicate orders, batch after batch: each order with the group's
    root, and the batch that gave it that root."""
    rows, pairs = transactions(spark, d), finance.e1_duplicate_pairs(spark, d).select("a_id", "b_id")
    at = rows.select("id", "at")
    dated = pairs.join(at.toDF("a_id", "a_at"), "a_id").join(at.toDF("b_id", "b_at"), "b_id").select("a_id", "b_id", F.greatest("a_at", "b_at").alias("at"))
    dated = written(dated, "dated")  # each batch reads its pairs, none makes all again
    store = Store(spark, new_path(spark, "groups"), consolidate.GROUP_TABLES)
    snapshot, since, changes = store.snapshot(), "1900-01-01", []
    for number, until in enumerate(BATCHES):
        inside = (F.col("at") >= F.lit(since).cast("timestamp_ntz")) & (F.col("at") < F.lit(until).cast("timestamp_ntz"))
        snapshot, changed = consolidate.extended(store, snapshot, rows.where(inside).select("id"), dated.where(inside))
        changes.append(changed.select("id", F.lit(number).alias("batch")))
        since = until
    last = changes[0]
    for more in changes[1:]:
        last = last.unionByName(more)
    return snapshot.table("by_id").join(last.groupBy("id").agg(F.max("batch").alias("batch")), "id")


#: Orders that a detection sees, by their day: each wants customers with one of them.
DETECTIONS = ("{0} < '1995-01-01'", "{0} < '1996-07-01'", "{0} >= '1996-07-01' AND {1} < 20")


def x17_clusters(spark, d):
    """Customers in blobs by nation, detected three times and parted twice: every
    cluster that the store then has. A blob's groups are its even and odd
    customers; those of nations 3, 8, ... have none, those of 4, 9, ... wait."""
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("member"), F.col("c_nationkey").alias("nation"))
    store = Store(spark, new_path(spark, "clusters"), clusters.CLUSTER_TABLES, 4)
    at = store.snapshot()
    for run, seen in enumerate(DETECTIONS):
        found = orders.where(seen.format("o_orderdate", "c_nationkey")).select(F.col("c_nationkey").alias("blob"), F.col("c_custkey").alias("member"))
        at = clusters.reconciled_blobs(store, at, found, run)
        if run < 2:
            of = at.table("members").join(at.table("clusters").where("status = 'candidate'"), "cluster_id").join(customers, "member")
            groups = of.where("nation % 5 < 3").select("cluster_id", (F.col("member") % 2).alias("grp"), "member")
            at = clusters.parted(store, at, of.where("nation % 5 < 4").select("cluster_id"), groups, run)
    return at.table("clusters")


def x14_traces(spark, d):
    """Each order's trace: a root and its lines; every third is traced again with its
    returned lines only, and urgent ones get a leaf under the root."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    root = orders.select(F.col("o_orderkey").alias("inbox"), F.lit(0).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("seq"), F.lit("root").alias("kind"), F.lit("order").alias("label"))
    first = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    child = first.select(F.col("l_orderkey").alias("inbox"), F.col("l_linenumber").cast("long").alias("node"), F.lit(0).cast("long").alias("parent"), (F.col("l_linenumber") - 1).cast("long").alias("seq"), F.lit("line").alias("kind"), F.col("l_returnflag").alias("label"))
    store = Store(spark, new_path(spark, "traces"), clusters.TRACE_TABLES, 4)
    at = clusters.retraced(store, store.snapshot(), root.unionByName(child.join(root, "inbox", "left_semi")))
    at = clusters.retraced(store, at, root.where("inbox % 3 = 0").unionByName(child.where("inbox % 3 = 0 AND label = 'R'").join(root, "inbox", "left_semi")))
    urgent = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("inbox"), F.lit(0).cast("long").alias("parent"), F.lit("error").alias("kind"), F.col("o_orderstatus").alias("label"))
    return clusters.attached(store, at, urgent).table("trace").select("inbox", "node", "parent", "seq", "kind", "label")


def x1_cursors(spark, d):
    """A cursor for each type of event, put forward by the first, the last, then the middle week."""
    rows = events(spark, d).select(F.col("event_type").alias("source"), F.col("event_id").alias("at"), F.dayofmonth("ts").alias("day"))
    store = Store(spark, new_path(spark, "cursors"), clusters.CURSOR_TABLES, 4)
    at = store.snapshot()
    for low, high in ((1, 7), (22, 31), (8, 21)):
        at = clusters.moved_cursors(store, at, rows.where(F.col("day").between(low, high)))
    return at.table("cursors")


def _messages(spark, d):
    """Orders as messages of three media, by their number."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda x: x.cast("string")
    medium = F.when(k % 3 == 0, "chat").when(k % 3 == 1, "social").otherwise("email")
    box = F.when(c % 4 == 0, "No-Reply").when(c % 4 == 1, F.concat(F.lit("jane.doe"), text(c % 30), F.lit("+x"))).when(c % 4 == 2, "mailer").otherwise(F.concat(F.lit("joe"), text(c)))
    domain = F.when(c % 5 == 0, "gmail.com").otherwise(F.concat(F.lit("mail.d"), text(c % 40), F.lit(".co.uk")))
    return table(spark, d, "orders").select(
        k.alias("message"), medium.alias("medium"), F.when(c % 17 > 0, text(c % 200)).alias("sender"), F.when(c % 3 > 0, F.concat(F.lit("@User"), text(c % 90))).alias("account"),
        F.when(k % 4 == 0, F.concat(F.lit(" Firm "), text(c % 25), F.lit(" Ltd."))).when(k % 4 == 1, "").alias("name"), (c % 11 == 0).alias("bot"), F.when(c % 2 == 0, "X").otherwise("insta").alias("platform"),
        F.concat(box, F.lit("@"), domain).alias("email"),
    )


def e15_senders(spark, d):
    """Senders of all messages, in three batches by number: each message's entry, with its name."""
    store = Store(spark, new_path(spark, "directory"), senders.DIRECTORY_TABLES, 4)
    people = table(spark, d, "supplier").where("s_suppkey < 10").select(F.col("s_suppkey").alias("id"), F.lit(senders.PERSON).alias("kind"), F.col("s_name").alias("name"))
    mails = people.select(F.lit("email").alias("platform"), F.lit("email").alias("kind"), F.concat(F.lit("jane.doe"), F.col("id").cast("string"), F.lit("@mail.d1.co.uk")).alias("value"), "id")
    at = store.commit(store.snapshot(), {"identities": people.withColumn("gone", F.lit(False)), "identifiers": mails.withColumn("gone", F.lit(False))})
    rows, found = _messages(spark, d), []
    most = rows.agg(F.max("message")).first()[0] + 1
    for k in range(3):
        at, mentions = senders.resolved_senders(store, at, rows.where((F.col("message") >= most * k // 3) & (F.col("message") < most * (k + 1) // 3)))
        found.append(mentions)
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return every.join(at.table("identities").select("id", "name"), "id").select("message", "kind", "name")


def _provider(spark, d, run: int):
    """Orders as a provider's events: other etags and titles in the second run, every ninth one deleted."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").where((k % 3 > 0) if run == 0 else (k % 3 < 2)).select(
        (k % 5).alias("account"), F.concat(F.lit("e"), k.cast("string")).alias("event"), ((k % 9 == 0) & F.lit(run > 0)).alias("deleted"), F.lit(1).alias("seq"), F.concat("o_orderpriority", F.lit(str(run))).alias("title"),
        F.to_date("o_orderdate").alias("starts_on"), F.lit(None).cast("date").alias("ends_on"), F.lit("confirmed").alias("status"), F.when(k % 7 > 0, F.when(k % 4 == 0, str(run)).otherwise("same")).alias("etag"), F.when(k % 13 == 0, k).alias("echo_of"),
    )
    older = rows.withColumns({"seq": F.lit(0), "title": F.lit("older"), "etag": F.lit("older")})
    return rows.unionByName(older)


def e24_synced(spark, d):
    """Two answers of a provider: each entry as it then is, with its changes."""
    store = Store(spark, new_path(spark, "calendar"), calendar_sync.TABLES, 4)
    at = store.snapshot()
    for run in range(2):
        at = calendar_sync.synced(store, at, _provider(spark, d, run), run)
    log = at.table("changes").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "action"))), lambda x: F.concat_ws(" ", x["run"].cast("string"), x["action"])), ", ").alias("changes"))
    return at.table("entries").join(log, "id").select("account", "event", "title", "status", "etag", "manual", "priority_rank", "changes")


_BY = "CASE " + " ".join(f"WHEN \"at\" < TIMESTAMP '{day}' THEN {k}" for k, day in enumerate(BATCHES)) + " END"
_ROOTS = " UNION ALL ".join(
    f"""SELECT {k} AS batch, x AS id, min(y) AS root FROM (SELECT id AS x, id AS y FROM b WHERE batch <= {k} UNION ALL SELECT x, y FROM reach{k}) GROUP BY 2""" for k in range(len(BATCHES))
)
_REACH = ", ".join(
    f"""reach{k} AS (SELECT x, y FROM l WHERE batch <= {k} UNION SELECT reach{k}.x, l.y FROM reach{k} JOIN l ON reach{k}.y = l.x AND l.batch <= {k})""" for k in range(len(BATCHES))
)

def _x17_sql() -> str:
    sign = "count(*) || '-' || sum(CAST('0x' || substr(md5(CAST(member AS VARCHAR)), 1, 15) AS HUGEINT))"
    live = "status IN ('confirmed', 'stale')"
    ctes = ["c0 AS (SELECT 0::BIGINT AS cluster_id, '' AS status, '' AS signature, '' AS blob_signature, 0::BIGINT AS members, 0::BIGINT AS seen WHERE false)", "m0 AS (SELECT 0::BIGINT AS cluster_id, 0::BIGINT AS member WHERE false)"]
    for r, seen in enumerate(DETECTIONS):
        c, m, k = f"c{r}", f"m{r}", f"r{r}"
        ctes += [
            f"d{r} AS (SELECT DISTINCT c_nationkey AS blob, c_custkey AS member FROM orders JOIN customer ON o_custkey = c_custkey WHERE {seen.format('o_orderdate', 'c_nationkey')})",
            f"s{r} AS (SELECT blob, count(*) AS members, {sign} AS signature FROM d{r} GROUP BY 1)",
            f"""n{r} AS (SELECT (SELECT coalesce(max(cluster_id), -1) FROM {c}) + row_number() OVER (ORDER BY signature) AS cluster_id, blob, signature, members FROM s{r}
                WHERE signature NOT IN (SELECT blob_signature FROM {c} WHERE {live} UNION ALL SELECT signature FROM {c} WHERE status IN ('candidate', 'rejected')))""",
            f"""{k}c AS (SELECT cluster_id, CASE WHEN {live} AND cluster_id NOT IN (SELECT cluster_id FROM {m} JOIN d{r} USING (member)) THEN 'dissolved' ELSE status END AS status, signature, blob_signature, members,
                CASE WHEN {live} AND blob_signature IN (SELECT signature FROM s{r}) THEN {r} ELSE seen END AS seen FROM {c} WHERE NOT (status = 'candidate' AND signature NOT IN (SELECT signature FROM s{r}))
                UNION ALL SELECT cluster_id, 'candidate', signature, signature, members, {r} FROM n{r})""",
            f"{k}m AS (SELECT * FROM {m} WHERE cluster_id IN (SELECT cluster_id FROM {k}c) UNION ALL SELECT cluster_id, member FROM n{r} JOIN d{r} USING (blob))",
        ]
        if r == 2:
            return f"WITH {', '.join(x.replace(' AS (', ' AS MATERIALIZED (', 1) for x in ctes)} SELECT cluster_id, status, signature, blob_signature, members, seen FROM {k}c"
        ctes += [
            f"p{r} AS (SELECT cluster_id, any_value(signature) AS signature, any_value(c_nationkey) AS nation FROM {k}c JOIN {k}m USING (cluster_id) JOIN customer ON c_custkey = member WHERE status = 'candidate' GROUP BY 1 HAVING nation % 5 < 4)",
            f"g{r} AS (SELECT dense_rank() OVER (ORDER BY cluster_id, member % 2) AS gid, member, signature AS blob_signature FROM p{r} JOIN {k}m USING (cluster_id) WHERE nation % 5 < 3)",
            f"o{r} AS (SELECT DISTINCT cluster_id FROM {k}c JOIN {k}m USING (cluster_id) WHERE {live} AND member IN (SELECT member FROM {k}m JOIN p{r} USING (cluster_id)))",
            f"""j{r} AS (SELECT gid, cluster_id, hits / (a + b - hits) AS score FROM (SELECT gid, cluster_id, count(*) AS hits FROM g{r} JOIN {k}m USING (member) JOIN o{r} USING (cluster_id) GROUP BY 1, 2)
                JOIN (SELECT gid, count(*) AS a FROM g{r} GROUP BY 1) USING (gid) JOIN (SELECT cluster_id, count(*) AS b FROM {k}m GROUP BY 1) USING (cluster_id) WHERE score >= 0.5)""",
            f"t{r} AS (SELECT gid, cluster_id FROM j{r} QUALIFY row_number() OVER (PARTITION BY gid ORDER BY score DESC, cluster_id) = 1 AND row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, gid) = 1)",
            f"""u{r} AS (SELECT gid, cluster_id FROM t{r} UNION ALL SELECT gid, (SELECT max(cluster_id) FROM {k}c) + row_number() OVER (ORDER BY gid) FROM (SELECT DISTINCT gid FROM g{r} WHERE gid NOT IN (SELECT gid FROM t{r})))""",
            f"""c{r + 1} AS (SELECT cluster_id, 'confirmed' AS status, {sign} AS signature, any_value(blob_signature) AS blob_signature, count(*) AS members, {r} AS seen FROM u{r} JOIN g{r} USING (gid) GROUP BY cluster_id
                UNION ALL SELECT cluster_id, CASE WHEN cluster_id IN (SELECT cluster_id FROM o{r}) THEN 'dissolved' WHEN cluster_id IN (SELECT cluster_id FROM p{r}) THEN 'rejected' ELSE status END, signature, blob_signature, members, seen
                FROM {k}c WHERE cluster_id NOT IN (SELECT cluster_id FROM t{r}) AND cluster_id NOT IN (SELECT cluster_id FROM p{r} WHERE nation % 5 < 3))""",
            f"""m{r + 1} AS (SELECT cluster_id, member FROM u{r} JOIN g{r} USING (gid) UNION ALL SELECT * FROM {k}m WHERE cluster_id NOT IN (SELECT cluster_id FROM t{r}) AND cluster_id NOT IN (SELECT cluster_id FROM p{r} WHERE nation % 5 < 3))""",
        ]
    raise AssertionError


#: The same, one message after another: a name is that of the entry's first message, but the last of a batch for people.
_E15 = """WITH m AS (SELECT o_orderkey AS message, CAST(o_orderkey * 3 // ((SELECT max(o_orderkey) FROM orders) + 1) AS BIGINT) AS batch, CASE o_orderkey % 3 WHEN 0 THEN 'chat' WHEN 1 THEN 'social' ELSE 'email' END AS medium, o_custkey AS c,
      CASE WHEN o_custkey % 17 > 0 THEN CAST(o_custkey % 200 AS VARCHAR) END AS sender, CASE WHEN o_custkey % 3 > 0 THEN 'user' || o_custkey % 90 END AS handle,
      CASE WHEN o_orderkey % 4 = 0 THEN ' Firm ' || o_custkey % 25 || ' Ltd.' END AS name, 'd' || o_custkey % 40 || '.co.uk' AS domain FROM orders),
    firsts AS (SELECT sender, min(batch) AS batch FROM m WHERE medium = 'chat' AND sender IS NOT NULL AND c % 11 > 0 GROUP BY 1),
    people AS (SELECT sender, m.batch, arg_max(handle, message) FILTER (handle IS NOT NULL OR true) AS h0, max(message) AS last FROM m JOIN firsts USING (sender, batch) WHERE medium = 'chat' AND c % 11 > 0 GROUP BY 1, 2),
    seen AS (SELECT p.sender, p.batch, m.handle, coalesce(m.name, '@' || m.handle, 'chat ' || p.sender) AS shown FROM people p JOIN m ON m.message = p.last),
    owner AS (SELECT *, first_value(shown) OVER (PARTITION BY coalesce('@' || handle, '#' || sender) ORDER BY batch, sender) AS entry FROM seen),
    named AS (SELECT domain, min(message) AS since FROM m WHERE medium = 'email' AND c % 4 IN (0, 2) AND c % 5 > 0 AND name IS NOT NULL GROUP BY 1),
    firm AS (SELECT domain, since, first_value(name) OVER (PARTITION BY trim(name) ORDER BY since) AS entry FROM named JOIN m USING (domain) WHERE message = since)
    SELECT message, 'person' AS kind, entry AS name FROM m JOIN owner USING (sender) WHERE medium = 'chat' AND c % 11 > 0
    UNION ALL SELECT message, 'unknown', '@User' || c % 90 FROM m WHERE medium = 'social' AND handle IS NOT NULL
    UNION ALL SELECT message, 'person', s_name FROM m JOIN supplier ON s_suppkey = c % 30 WHERE medium = 'email' AND c % 4 = 1 AND c % 5 > 0 AND c % 40 = 1 AND s_suppkey < 10
    UNION ALL SELECT message, 'company', trim(entry) FROM m JOIN firm USING (domain) WHERE medium = 'email' AND c % 4 IN (0, 2) AND c % 5 > 0 AND message >= since"""

SQL = {
    "e10_incremental": f"""WITH RECURSIVE b AS MATERIALIZED (SELECT id, {_BY} AS batch FROM ({finance._T})), p AS MATERIALIZED (SELECT a_id, b_id, greatest(x.batch, y.batch) AS batch FROM ({finance._PAIRS}) JOIN b x ON x.id = a_id JOIN b y ON y.id = b_id),
        l AS MATERIALIZED (SELECT a_id AS x, b_id AS y, batch FROM p UNION ALL SELECT b_id, a_id, batch FROM p), {_REACH}, r AS MATERIALIZED ({_ROOTS})
        SELECT id, arg_max(root, batch) AS root, CAST(min(batch) FILTER (root = last) AS INTEGER) AS batch FROM (SELECT *, last_value(root) OVER (PARTITION BY id ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM r) GROUP BY 1""",
    "e15_senders": _E15,
    "e24_synced": """WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS p FROM orders), x AS (SELECT *, k % 3 > 0 AS a, k % 3 < 2 AND k % 9 > 0 AS b, k % 3 < 2 AND k % 9 = 0 AS del,
          CASE WHEN k % 7 > 0 AND k % 4 > 0 THEN true ELSE false END AS same FROM o), y AS (SELECT *, b AND NOT (a AND same) AS fresh FROM x WHERE a OR b)
        SELECT k % 5 AS account, 'e' || k AS event, p || CASE WHEN fresh THEN 1 ELSE 0 END AS title, CASE WHEN del THEN 'cancelled' ELSE 'confirmed' END AS status,
        CASE WHEN k % 7 > 0 THEN CASE WHEN k % 4 = 0 THEN CASE WHEN fresh THEN '1' ELSE '0' END ELSE 'same' END END AS etag, k % 13 <> 0 AS manual, CASE WHEN k % 13 <> 0 THEN 100 ELSE 0 END AS priority_rank,
        array_to_string(list_filter([CASE WHEN a THEN '0 created' END, CASE WHEN a AND del THEN '1 deleted' WHEN a AND fresh THEN '1 modified' WHEN b AND NOT a THEN '1 created' END], lambda c: c IS NOT NULL), ', ') AS changes FROM y""",
    "x17_clusters": _x17_sql(),
    "x14_traces": """WITH o AS (SELECT o_orderkey AS inbox, o_orderstatus, o_orderpriority FROM orders), l AS (SELECT l_orderkey AS inbox, CAST(l_linenumber AS BIGINT) AS node, min(l_returnflag) AS label FROM lineitem WHERE l_orderkey IN (SELECT inbox FROM o) GROUP BY 1, 2),
        k AS (SELECT * FROM l WHERE inbox % 3 <> 0 OR label = 'R'), b AS (SELECT inbox, 0::BIGINT AS node, NULL::BIGINT AS parent, 0::BIGINT AS seq, 'root' AS kind, 'order' AS label FROM o UNION ALL SELECT inbox, node, 0, node - 1, 'line', label FROM k)
        SELECT * FROM b UNION ALL SELECT inbox, (SELECT max(node) FROM b WHERE b.inbox = o.inbox) + row_number() OVER (PARTITION BY inbox), 0, coalesce((SELECT max(seq) + 1 FROM b WHERE b.inbox = o.inbox AND parent IS NOT NULL), 0) + row_number() OVER (PARTITION BY inbox) - 1, 'error', o_orderstatus
        FROM o WHERE o_orderpriority = '1-URGENT'""",
    "x1_cursors": """SELECT event_type AS source, max(event_id) AS "at", CAST(2 AS BIGINT) AS batches FROM events WHERE day(ts) <= 7 OR day(ts) >= 22 GROUP BY 1""",
}
QUERIES = {name: globals()[name] for name in SQL}
