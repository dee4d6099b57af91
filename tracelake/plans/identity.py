"""Queries over identities, rules for senders, places, and small functions of columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.functions import text as T
from tracelake.operators import hierarchy, identity, joins, places, senders
from tracelake.shared import written
from tracelake.sources.tables import events, messages, table, transactions


def _known(spark, d):
    """Suppliers as known identities: people, companies and some unknown."""
    k = F.col("s_suppkey")
    kind = F.when(k % 4 == 0, identity.PERSON).when(k % 4 == 1, identity.UNKNOWN).otherwise("company")
    name = F.concat(F.lit("Agent "), (k % 60).cast("string"))
    return table(spark, d, "supplier").select(k.alias("id"), kind.alias("kind"), name.alias("name"), F.when(k % 5 == 0, F.array(F.concat(F.lit("al "), (k % 9).cast("string")))).otherwise(F.array().cast("array<string>")).alias("aliases"))


def _identifiers(spark, d):
    k = F.col("s_suppkey")
    kind = F.when(k % 3 == 0, "email").when(k % 3 == 1, "domain").otherwise("handle")
    value = F.when(k % 3 == 0, F.concat(F.lit("a"), k.cast("string"), F.lit("@x.org"))).when(k % 3 == 1, F.concat(F.lit("d"), (k % 40).cast("string"), F.lit(".org"))).otherwise(F.concat(F.lit("h"), (k % 20).cast("string")))
    return table(spark, d, "supplier").select(k.alias("identity"), kind.alias("kind"), F.when(k % 3 == 2, F.when(k % 2 == 0, "p").otherwise("q")).alias("platform"), value.alias("value"))


def _mentions(spark, d):
    k = F.col("c_custkey")
    email = F.when(k % 5 == 0, F.concat(F.lit("A"), (k % 90).cast("string"), F.lit("+x@x.org"))).when(k % 5 == 1, F.concat(F.lit("someone@d"), (k % 50).cast("string"), F.lit(".org"))).when(k % 25 == 2, "noreply@x.org")
    return table(spark, d, "customer").select(
        k.alias("id"), F.when(k % 3 == 0, identity.PERSON).when(k % 3 == 1, "company").alias("kind"),
        F.when(k % 7 < 4, F.concat(F.lit("agent  "), (k % 70).cast("string"))).when(k % 7 < 6, F.concat(F.lit("AL "), (k % 11).cast("string"))).otherwise("").alias("name"), email.alias("email"),
        F.when(k % 4 == 0, F.concat(F.lit("@H"), (k % 25).cast("string"))).alias("handle"), F.when(k % 8 == 0, "p").alias("platform"),
    )


def e13_resolved(spark, d):
    """Customers as mentions of suppliers."""
    return identity.resolved(_mentions(spark, d), _known(spark, d), _identifiers(spark, d))


def e14_alike(spark, d):
    """Part types with their names against distinct names: the most alike of the same brand class."""
    parts = table(spark, d, "part")
    kind = F.when(F.col("p_partkey") % 2 == 0, "even").otherwise("odd")
    probe = F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 3 == 0, F.lit("x")))
    left = parts.select(F.col("p_partkey").alias("id"), kind.alias("kind"), probe.alias("name"))
    known = parts.groupBy(kind.alias("kind"), F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    return identity.alike(left, known).select("id", "identity", F.round("score", 6).alias("score"), "decision")


def e18_ancestors(spark, d):
    parents = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") > 0, F.floor(F.col("s_suppkey") / 3)).alias("parent"))
    return hierarchy.ancestors(parents)


def a42_trace_costs(spark, d):
    """Each node's own and whole cost: a user's calls are shared by the nodes that name the user."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 15).alias("user_id"))
    calls = events(spark, d).groupBy("user_id").agg(F.sum("value").alias("cost"), F.count(F.lit(1)).alias("calls"))
    nodes = s.groupBy("user_id").agg(F.count(F.lit(1)).alias("nodes"))
    own = s.join(calls, "user_id", "left").join(nodes, "user_id").select("id", (F.coalesce("cost", F.lit(0.0)) / F.col("nodes")).alias("own"), F.coalesce("calls", F.lit(0)).alias("calls"))
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") > 0, F.floor(F.col("s_suppkey") / 3)).alias("parent")).join(own, "id")
    whole = hierarchy.toured(nodes.withColumn("seq", F.col("id")), "seq", ("own", "calls"))
    return whole.select("id", F.round("own", 4).alias("whole"), F.col("calls").cast("long").alias("calls")).join(own.select("id", F.round("own", 4).alias("own")), "id").select("id", "own", "whole", "calls")


def e20_domain_owners(spark, d):
    """Suppliers that might own the domains of orders' customers: those of their orders, those named like the domain, and those above."""
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("Group n"), (k % 9).cast("string"))).otherwise(F.concat(F.lit("maker "), k.cast("string")))
    companies = table(spark, d, "supplier").select(k.alias("id"), name.alias("name"), F.when(k % 5 == 0, F.floor(k / 3)).alias("parent"))
    c = F.col("o_custkey") % 60
    mails = table(spark, d, "orders").select(F.col("o_orderkey").alias("message"), F.when(c % 5 > 0, F.concat(F.when(c % 2 == 0, F.lit("group-n")).otherwise(F.lit("maker")), c.cast("string"), F.lit(".com"))).otherwise("").alias("domain"))
    mentions = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_orderkey").alias("message"), F.col("l_suppkey").alias("id"))
    return senders.domain_owners(mails, mentions, companies)


def e23_upserted(spark, d):
    """Suppliers after changes: some new, some with another etag, some deleted."""
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(k.alias("id"), F.col("s_name").alias("name"), (k % 5).cast("string").alias("etag"), F.lit(False).alias("deleted"))
    changes = rows.where("id % 3 = 0").select(
        F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + 1_000_000).alias("id"), F.concat("name", F.lit("!")).alias("name"),
        F.when(F.col("id") % 4 == 0, F.col("etag")).otherwise("z").alias("etag"), (F.col("id") % 9 == 0).alias("deleted"),
    )
    return identity.upserted(rows, changes, "id")


def e26_cells(spark, d):
    """Places of cells of four decimals, to even at half; a fix in transit has none."""
    e = events(spark, d).select("event_id", "user_id", "ts", "value", (F.col("value") / 1000).alias("at"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 1e6
    moved = F.abs(F.col("at") - F.lag("at").over(w)) * 111_000
    return e.withColumn("speed", moved / seconds).select("event_id", F.bround(F.col("value").cast("decimal(18,2)") / 1000, 4).cast("double").alias("cell"), F.coalesce(F.col("speed") > 1.5, F.lit(False)).alias("in_transit"))


def e27_places(spark, d):
    """Purchases with the place of the nearest view or click of their user within three
    hours; cells that a sign-up has been in have a place."""
    e = events(spark, d)
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0))
    lat, lng = F.col("value") / 1000, (k % 3) / 100
    spot = F.concat(F.lit("Spot "), (k % 10).cast("string"))
    buys = e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.col("user_id").alias("user"), F.col("ts").alias("at"), spot.alias("place"), (k % 7 > 0).alias("exact"), (k % 11 == 0).alias("done"))
    fixes = e.where("event_type IN ('view', 'click')").select(F.col("user_id").alias("user"), F.col("ts").alias("at"), lat.alias("lat"), lng.alias("lng"))
    cells = e.where("event_type = 'signup'").groupBy(places.cell(lat).alias("lat"), places.cell(lng).alias("lng")).agg(F.min_by(F.concat(F.lit("the "), F.lower(spot)), "event_id").alias("name"))
    return places.enriched(buys, fixes, cells, 3 * 3600).drop("user")


def e28_promoted(spark, d):
    """Kinds of the unknown after a classification that knows some of them; others keep theirs."""
    found = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 5000, "company").otherwise("person").alias("found"))
    rows = _known(spark, d).join(found, "id", "left")
    return rows.select("id", F.when(F.col("kind") == identity.UNKNOWN, F.coalesce("found", "kind")).otherwise(F.col("kind")).alias("kind"))


#: id, effect, sender (null: any), language (null: any), least length (null: any).
SENDER_RULES = ((1, "allow", None, "en", None), (2, "block", "web", None, None), (3, "allow", "web", "de", 2000), (4, "block", None, None, 9000), (5, "allow", None, "es", 500))


def f16_decided(spark, d):
    """The first rule that blocks and the first that allows a message; both: a conflict."""
    def matches(sender, lang, least):
        conditions = [F.col(c) == v for c, v in (("sender", sender), ("lang", lang)) if v is not None] + ([F.col("n_chars") >= least] if least is not None else [])
        out = F.lit(True)
        for c in conditions:
            out &= c
        return out

    first = lambda effect: F.coalesce(*[F.when(matches(*r[2:]), F.lit(r[0])) for r in SENDER_RULES if r[1] == effect])
    rows = messages(spark, d).withColumns({"block_id": first("block"), "allow_id": first("allow")})
    decision = F.when(F.col("block_id").isNotNull() & F.col("allow_id").isNotNull(), "conflict").when(F.col("block_id").isNotNull(), "block").when(F.col("allow_id").isNotNull(), "allow")
    return rows.select("doc_id", "block_id", "allow_id", decision.alias("decision"))


def j19_wildcards(spark, d):
    """Rules of each message, where a null of a rule stands for anything: by the columns that a rule names."""
    rules = spark.createDataFrame(SENDER_RULES, "id int, effect string, r_sender string, r_lang string, least int")
    m = messages(spark, d).select("doc_id", "sender", "lang", "n_chars")
    parts = []
    for sender in (True, False):
        for lang in (True, False):
            some = rules.where(F.col("r_sender").isNotNull() if sender else F.col("r_sender").isNull()).where(F.col("r_lang").isNotNull() if lang else F.col("r_lang").isNull())
            on = [m["sender"] == some["r_sender"]] * sender + [m["lang"] == some["r_lang"]] * lang
            parts.append(m.join(F.broadcast(some), on) if on else m.crossJoin(F.broadcast(some)))  # as many rows as there are rules without either: a list in this file
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return rows.where("least IS NULL OR n_chars >= least").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def f24_grounded(spark, d):
    """Whether both ends of a pair, of three letters or more, stand in the text."""
    low = F.lower("text")
    both = lambda *words: F.forall(F.array(*map(F.lit, words)), lambda w: (F.length(w) >= 3) & F.contains(low, w))
    return table(spark, d, "documents").select("doc_id", both("the", "and").alias("the_and"), both("der", "un").alias("der_un"))


def f26_coerced(spark, d):
    """Free words as the values that a column may have; others as a default."""
    p = F.upper(F.trim(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))))
    known = F.when(p.isin("URGENT", "HIGH", "LOW"), F.lower(p)).otherwise("other")
    return transactions(spark, d).select(F.col("priority").alias("o_orderpriority"), "status").select(known.alias("priority"), F.when(F.col("status").isin("F", "O"), F.col("status")).otherwise("F").alias("status")).groupBy("priority", "status").agg(F.count(F.lit(1)).alias("n"))


def f27_instants(spark, d):
    """The instant of each order: its time, else its day, else the last of its lines; and how exact."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_shipdate").alias("last"))
    t = transactions(spark, d).join(lines, "id", "left")
    time, day = F.when(F.col("id") % 3 == 0, F.col("at")), F.when(F.col("id") % 3 == 1, F.date_trunc("day", "at").cast("timestamp_ntz"))
    exact = F.when(time.isNotNull(), "time").when(day.isNotNull(), "day").when(F.col("last").isNotNull(), "inferred")
    return t.select("id", F.coalesce(time, day, "last").alias("instant"), exact.alias("precision"))


def f29_series_keys(spark, d):
    """Orders by series: of a standing order's customer, else status and priority, else alone."""
    t = transactions(spark, d)
    key = F.when(F.col("customer") % 5 == 0, F.concat(F.lit("c"), F.col("customer").cast("string"))).when(F.col("id") % 2 == 0, F.concat_ws("/", "status", "priority")).otherwise(F.concat(F.lit("o"), F.col("id").cast("string")))
    return t.groupBy(key.alias("series")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def i16_extensions(spark, d):
    """The extension of an address's last part, else by its host; the content type without parameters."""
    name = F.substring_index(F.split_part("url", F.lit("?"), F.lit(1)), "/", -1)
    found = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]{1,5})$", 1))
    kind = F.lower(F.trim(F.split_part(F.concat(F.lit(" Text/HTML ; q="), F.col("page_id").cast("string")), F.lit(";"), F.lit(1))))
    return table(spark, d, "pages").select("page_id", F.when(found != "", found).otherwise("html").alias("extension"), kind.alias("content_type"))


def i18_rendered(spark, d):
    """Sender, subject and size of each message as one line."""
    n = F.col("n_chars")
    size = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat(F.floor((n * 2 + 1024) / 2048).cast("string"), F.lit(" KB")))
    return table(spark, d, "documents").select("doc_id", F.concat_ws(": ", "source", F.concat_ws(", ", "lang", size)).alias("line"))


def s36_promoted(spark, d):
    """Ids of a log record as columns, the rest as it is."""
    return events(spark, d).select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.get_json_object("props", "$.trace").alias("trace"), (F.get_json_object("props", "$.k").isNull()).alias("bare"))


def r5_confirmed_hints(spark, d):
    """Pairs of parts met in an order, without those that a supplier ties together anyway."""
    few = joins.pairs_in_groups(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", 4)[0].select("a", "b")
    of = written(table(spark, d, "lineitem").groupBy("l_partkey").agg(F.collect_set("l_suppkey").alias("s")), "suppliers")
    both = few.join(of.toDF("a", "_a"), "a").join(of.toDF("b", "_b"), "b")  # a row a pair, whatever number of suppliers
    return both.groupBy(F.arrays_overlap("_a", "_b").alias("tied")).agg(F.count(F.lit(1)).alias("n"))


def r20_labels(spark, d):
    """A message is a receipt if it has marks, bulk by its length, chat by its language, else unknown."""
    m = messages(spark, d)
    label = F.when(F.col("relevant"), "receipt").when(F.col("n_chars") > 4000, "bulk").when(F.col("lang").isin("en", "es"), "chat").otherwise("unknown")
    return m.groupBy("sender", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def r27_judging_order(spark, d):
    """The fifty orders with the most pairs of suppliers left to judge, in the order of judging: the budget of a run."""
    n = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct().groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    rows = n.where("n > 1").select("l_orderkey", F.least(F.expr("n * (n - 1) div 2"), F.lit(40)).alias("pairs"))
    return rows.orderBy(F.desc("pairs"), "l_orderkey").limit(50)


def u6_shared(spark, d):
    """Suppliers that two neighbouring parts share."""
    sets = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.collect_set("l_suppkey").alias("s"))
    after = sets.select((F.col("part") - 1).alias("part"), F.col("s").alias("t"))
    return sets.join(after, "part").select("part", F.size(F.array_intersect("s", "t")).alias("shared"))


_KNOWN = """SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'unknown' ELSE 'company' END AS kind, CASE s_suppkey % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'unknown' ELSE 'other' END AS grp,
    'agent ' || s_suppkey % 60 AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'al ' || s_suppkey % 9 END AS alias,
    CASE s_suppkey % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'domain' ELSE 'handle' END AS ikind, CASE WHEN s_suppkey % 3 = 2 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'p' ELSE 'q' END END AS platform,
    CASE s_suppkey % 3 WHEN 0 THEN 'a' || s_suppkey || '@x.org' WHEN 1 THEN 'd' || s_suppkey % 40 || '.org' ELSE 'h' || s_suppkey % 20 END AS value FROM supplier"""
_MENTIONS = """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'company' END AS kind, CASE c_custkey % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'other' END AS grp,
    CASE WHEN c_custkey % 7 < 4 THEN 'agent ' || c_custkey % 70 WHEN c_custkey % 7 < 6 THEN 'al ' || c_custkey % 11 END AS name,
    CASE c_custkey % 5 WHEN 0 THEN 'a' || c_custkey % 90 || '@x.org' WHEN 1 THEN 'someone@d' || c_custkey % 50 || '.org' END AS email,
    CASE c_custkey % 5 WHEN 0 THEN 'x.org' WHEN 1 THEN 'd' || c_custkey % 50 || '.org' END AS domain,
    CASE WHEN c_custkey % 4 = 0 THEN 'h' || c_custkey % 25 END AS handle, CASE WHEN c_custkey % 8 = 0 THEN 'p' END AS platform FROM customer"""
_ONE = "CASE WHEN count(DISTINCT id) = 1 THEN min(id) END"
_MARKED = "SELECT d.doc_id, source AS sender, lang, n_chars, quality = 1 AS relevant, toxic = 1 AS blocked FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
_UP = "SELECT s_suppkey AS id, CASE WHEN s_suppkey > 0 THEN s_suppkey // 3 END AS parent FROM supplier"
_ANCESTORS = f"""WITH RECURSIVE p AS ({_UP}), t AS (SELECT id, id AS ancestor, 0::BIGINT AS steps FROM p UNION ALL
    SELECT t.id, p.parent, t.steps + 1 FROM t JOIN p ON p.id = t.ancestor WHERE p.parent IS NOT NULL) SELECT id, ancestor, steps FROM t"""
_RULE = [(i, e, " AND ".join([f"sender = '{s}'"] * (s is not None) + [f"lang = '{lang}'"] * (lang is not None) + [f"n_chars >= {n}"] * (n is not None))) for i, e, s, lang, n in SENDER_RULES]
_FIRST = {e: "CASE " + " ".join(f"WHEN {c} THEN {i}" for i, effect, c in _RULE if effect == e) + " END" for e in ("block", "allow")}
_GRAMS = """list_distinct(flatten(list_transform(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda w: w <> ''),
    lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""

SQL = {
    "e13_resolved": f"""WITH k AS ({_KNOWN}), m AS ({_MENTIONS}), x AS (SELECT m.id, m.kind,
        (SELECT min(id) FROM k WHERE ikind = 'email' AND value = m.email) AS e,
        (SELECT min(id) FROM k WHERE ikind = 'domain' AND value = m.domain AND kind <> 'person' AND (m.kind IS NULL OR m.kind <> 'person')) AS d,
        CASE WHEN m.platform IS NOT NULL THEN (SELECT min(id) FROM k WHERE ikind = 'handle' AND value = m.handle AND platform = m.platform)
          ELSE (SELECT {_ONE} FROM k WHERE ikind = 'handle' AND value = m.handle) END AS h,
        (SELECT min(id) FROM k WHERE name = m.name AND grp = m.grp) AS n, (SELECT min(id) FROM k WHERE alias = m.name AND grp = m.grp) AS a,
        CASE WHEN m.kind IS NOT NULL THEN (SELECT min(id) FROM k WHERE name = m.name AND grp = 'unknown') END AS cn,
        CASE WHEN m.kind IS NOT NULL THEN (SELECT min(id) FROM k WHERE alias = m.name AND grp = 'unknown') END AS ca,
        CASE WHEN m.kind IS NULL THEN (SELECT {_ONE} FROM k WHERE name = m.name) END AS un, CASE WHEN m.kind IS NULL THEN (SELECT {_ONE} FROM k WHERE alias = m.name) END AS ua FROM m)
        SELECT id, coalesce(e, d, h, n, a, cn, ca, un, ua) AS identity, CASE WHEN e IS NOT NULL THEN 'email' WHEN d IS NOT NULL THEN 'domain' WHEN h IS NOT NULL THEN 'handle'
        WHEN n IS NOT NULL THEN 'exact_name' WHEN a IS NOT NULL THEN 'alias' WHEN cn IS NOT NULL THEN 'exact_name' WHEN ca IS NOT NULL THEN 'alias'
        WHEN un IS NOT NULL THEN 'exact_name' WHEN ua IS NOT NULL THEN 'alias' END AS method FROM x""",
    "e14_alike": f"""WITH k AS (SELECT *, {_GRAMS} AS g FROM (SELECT p_partkey % 2 AS kind, p_name AS name, min(p_partkey) AS id FROM part GROUP BY 1, 2)),
        l AS (SELECT *, {_GRAMS} AS g FROM (SELECT p_partkey AS id, p_partkey % 2 AS kind, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' x' ELSE '' END AS name FROM part)),
        s AS (SELECT l.id, k.id AS identity, len(list_intersect(l.g, k.g)) / len(list_distinct(list_concat(l.g, k.g))) AS score, levenshtein(l.name, k.name) AS e FROM l JOIN k ON l.kind = k.kind),
        b AS (SELECT * FROM s WHERE score >= 0.55 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, e, identity) = 1)
        SELECT l.id, identity, round(score, 6) AS score, CASE WHEN score >= 0.92 THEN 'merge' WHEN score IS NOT NULL THEN 'candidate' ELSE 'new' END AS decision FROM l LEFT JOIN b USING (id)""",
    "e18_ancestors": _ANCESTORS,
    "a42_trace_costs": f"""WITH c AS (SELECT user_id, sum(value) AS cost, count(*) AS calls FROM events GROUP BY 1), o AS (SELECT s_suppkey AS id,
        coalesce(cost, 0) / count(*) OVER (PARTITION BY s_suppkey % 15) AS own, coalesce(calls, 0) AS calls FROM supplier LEFT JOIN c ON c.user_id = s_suppkey % 15),
        w AS (SELECT ancestor AS id, round(sum(own), 4) AS whole, sum(calls) AS calls FROM ({_ANCESTORS}) JOIN o USING (id) GROUP BY 1)
        SELECT id, round(own, 4) AS own, whole, w.calls FROM w JOIN o USING (id)""",
    "e20_domain_owners": f"""WITH RECURSIVE k AS MATERIALIZED (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'group n' || s_suppkey % 9 ELSE 'maker ' || s_suppkey END AS name, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey // 3 END AS parent FROM supplier),
        m AS MATERIALIZED (SELECT o_orderkey AS message, CASE WHEN o_custkey % 2 = 0 THEN 'group-n' ELSE 'maker' END || o_custkey % 60 AS name FROM orders WHERE o_custkey % 5 > 0),
        met AS (SELECT m.name, l_suppkey AS id, count(DISTINCT message) AS n FROM m JOIN lineitem ON l_orderkey = message AND l_returnflag = 'R' AND l_quantity > 45 WHERE l_suppkey IN (SELECT id FROM k) GROUP BY 1, 2),
        a AS (SELECT name, {_GRAMS} AS g FROM (SELECT DISTINCT name FROM m)), b AS (SELECT id, {_GRAMS} AS g FROM k),
        alike AS (SELECT a.name, b.id, 0 AS n FROM a JOIN b ON len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) >= 0.55),
        both_of AS (SELECT name, id, max(n) AS n FROM (SELECT * FROM met UNION ALL SELECT * FROM alike) GROUP BY 1, 2),
        d AS MATERIALIZED (SELECT name, id, n FROM both_of QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, id) <= 12),
        up AS (SELECT name, id FROM d UNION SELECT up.name, k.parent FROM up JOIN k ON k.id = up.id WHERE k.parent IN (SELECT id FROM k))
        SELECT up.name || '.com' AS domain, up.id, CASE WHEN n > 0 THEN 'met' WHEN n = 0 THEN 'alike' ELSE 'above' END AS origin FROM up LEFT JOIN d ON d.name = up.name AND d.id = up.id""",
    "e23_upserted": """WITH r AS (SELECT s_suppkey AS id, s_name AS name, CAST(s_suppkey % 5 AS VARCHAR) AS etag FROM supplier),
        c AS (SELECT CASE WHEN id % 2 = 0 THEN id ELSE id + 1000000 END AS id, name || '!' AS name, CASE WHEN id % 4 = 0 THEN etag ELSE 'z' END AS etag, id % 9 = 0 AS deleted FROM r WHERE id % 3 = 0),
        x AS (SELECT id, r.name AS n, r.etag AS e, c.name AS cn, c.etag AS ce, c.deleted AS cd, CASE WHEN c.etag IS NULL THEN 'kept' WHEN c.deleted THEN 'deleted' WHEN r.name IS NULL THEN 'added'
        WHEN r.etag = c.etag THEN 'kept' ELSE 'updated' END AS change FROM r FULL JOIN c USING (id))
        SELECT id, CASE WHEN change IN ('added', 'updated') THEN cn ELSE n END AS name, CASE WHEN change IN ('added', 'updated') THEN ce ELSE e END AS etag, change = 'deleted' AS deleted, change
        FROM x WHERE NOT (change = 'deleted' AND n IS NULL)""",
    "e26_cells": """SELECT event_id, (c // 10 + CASE WHEN c % 10 > 5 OR (c % 10 = 5 AND c // 10 % 2 = 1) THEN 1 ELSE 0 END) / 10000 AS cell, coalesce(abs(value / 1000 - lag(value / 1000) OVER w) * 111000 / ((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6) > 1.5, false) AS in_transit
        FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "e27_places": """WITH e AS (SELECT *, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, value / 1000 AS lat FROM events),
        r AS (SELECT *, k % 3 / 100 AS lng, CAST(round(value * 100) AS BIGINT) AS h FROM e), q AS (SELECT *, h // 10 + CASE WHEN h % 10 > 5 OR (h % 10 = 5 AND h // 10 % 2 = 1) THEN 1 ELSE 0 END AS clat, k % 3 AS clng FROM r),
        f AS (SELECT *, coalesce(sqrt(pow((lat - lag(lat) OVER w) * 111000, 2) + pow((lng - lag(lng) OVER w) * 111000 * cos(radians(lat)), 2)) / nullif((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 0) > 1.5, false) AS in_transit
          FROM q WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY ts, lat, lng)),
        c AS (SELECT clat, clng, arg_min('the spot ' || k % 10, event_id) AS name FROM q WHERE event_type = 'signup' GROUP BY 1, 2),
        b AS (SELECT event_id AS id, 'Spot ' || k % 10 AS place, ts, user_id, k FROM q WHERE event_type = 'purchase'), t AS (SELECT * FROM b WHERE k % 7 > 0 AND k % 11 <> 0),
        n AS (SELECT t.id, arg_min(f.event_id, (abs(epoch_us(t.ts) - epoch_us(f.ts)), f.ts)) AS fix FROM t JOIN f ON f.user_id = t.user_id AND abs(epoch_us(t.ts) - epoch_us(f.ts)) <= 10800000000 GROUP BY 1),
        g AS (SELECT t.id, t.place, CASE WHEN fix IS NULL THEN 'no_fix' WHEN in_transit THEN 'in_transit' WHEN name IS NULL THEN 'no_result' ELSE 'resolved' END AS outcome, name
          FROM t LEFT JOIN n ON n.id = t.id LEFT JOIN f ON f.event_id = fix LEFT JOIN c ON c.clat = f.clat AND c.clng = f.clng)
        SELECT id, outcome, CASE WHEN outcome = 'resolved' THEN name ELSE place END AS place, CASE WHEN outcome = 'resolved' THEN place END AS place_extracted,
        CASE WHEN outcome = 'resolved' THEN contains(name, lower(place)) END AS matches_extracted FROM g
        UNION ALL SELECT id, 'skipped', place, NULL, NULL FROM b WHERE NOT (k % 7 > 0 AND k % 11 <> 0)""",
    "e28_promoted": f"""SELECT id, CASE WHEN kind = 'unknown' AND s_acctbal > 5000 THEN 'company' WHEN kind = 'unknown' AND s_acctbal > 0 THEN 'person' ELSE kind END AS kind
        FROM ({_KNOWN}) JOIN supplier ON s_suppkey = id""",
    "f16_decided": f"""SELECT *, CASE WHEN block_id IS NOT NULL AND allow_id IS NOT NULL THEN 'conflict' WHEN block_id IS NOT NULL THEN 'block' WHEN allow_id IS NOT NULL THEN 'allow' END AS decision
        FROM (SELECT doc_id, {_FIRST["block"]} AS block_id, {_FIRST["allow"]} AS allow_id FROM ({_MARKED}))""",
    "j19_wildcards": " UNION ALL ".join(f"SELECT * FROM (SELECT {i} AS id, count(*) AS n FROM ({_MARKED}) WHERE {c}) WHERE n > 0" for i, _, c in _RULE),
    "f24_grounded": "SELECT doc_id, contains(lower(text), 'the') AND contains(lower(text), 'and') AS the_and, false AS der_un FROM documents",
    "f26_coerced": """SELECT CASE WHEN p IN ('URGENT', 'HIGH', 'LOW') THEN lower(p) ELSE 'other' END AS priority, CASE WHEN s IN ('F', 'O') THEN s ELSE 'F' END AS status, count(*) AS n
        FROM (SELECT upper(split_part(o_orderpriority, '-', 2)) AS p, o_orderstatus AS s FROM orders) GROUP BY 1, 2""",
    "f27_instants": """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate WHEN 1 THEN date_trunc('day', o_orderdate) ELSE l END AS instant,
        CASE WHEN o_orderkey % 3 = 0 THEN 'time' WHEN o_orderkey % 3 = 1 THEN 'day' WHEN l IS NOT NULL THEN 'inferred' END AS "precision"
        FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS l FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "f29_series_keys": """SELECT CASE WHEN o_custkey % 5 = 0 THEN 'c' || o_custkey WHEN o_orderkey % 2 = 0 THEN o_orderstatus || '/' || o_orderpriority ELSE 'o' || o_orderkey END AS series,
        count(*) AS n, min(o_orderkey) AS first_id FROM orders GROUP BY 1""",
    "i16_extensions": r"""SELECT page_id, CASE WHEN e <> '' THEN e ELSE 'html' END AS extension, 'text/html' AS content_type FROM (SELECT page_id,
        lower(regexp_extract(regexp_extract(split_part(url, '?', 1), '[^/]*$'), '\.([A-Za-z0-9]{1,5})$', 1)) AS e FROM pages)""",
    "i18_rendered": """SELECT doc_id, source || ': ' || lang || ', ' || CASE WHEN n_chars < 1024 THEN n_chars || ' B' ELSE (n_chars * 2 + 1024) // 2048 || ' KB' END AS line FROM documents""",
    "s36_promoted": """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.trace') AS trace, json_extract_string(props, '$.k') IS NULL AS bare FROM events""",
    "r5_confirmed_hints": """WITH l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), f AS (SELECT * FROM l QUALIFY count(*) OVER (PARTITION BY l_orderkey) BETWEEN 2 AND 4),
        p AS (SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM f x JOIN f y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey)
        SELECT EXISTS (SELECT 1 FROM lineitem u JOIN lineitem v ON u.l_suppkey = v.l_suppkey WHERE u.l_partkey = p.a AND v.l_partkey = p.b) AS tied, count(*) AS n FROM p GROUP BY 1""",
    "r20_labels": f"""SELECT sender, CASE WHEN relevant THEN 'receipt' WHEN n_chars > 4000 THEN 'bulk' WHEN lang IN ('en', 'es') THEN 'chat' ELSE 'unknown' END AS label, count(*) AS n FROM ({_MARKED}) GROUP BY 1, 2""",
    "r27_judging_order": """SELECT l_orderkey, least(n * (n - 1) // 2, 40) AS pairs FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) WHERE n > 1
        ORDER BY pairs DESC, l_orderkey LIMIT 50""",
    "u6_shared": """WITH s AS (SELECT l_partkey AS part, list(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1) SELECT a.part, len(list_intersect(a.s, b.s)) AS shared FROM s a JOIN s b ON b.part = a.part + 1""",
}
QUERIES = {name: globals()[name] for name in SQL}
