"""Queries over the directory and over requests: hierarchies, links, domains, answers, orders of work."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import identifiers, json_text, text
from tracelake.operators import dependencies, hierarchy, ingest, rules
from tracelake.sources.tables import events, table

SALVAGED = (
    "{0}", "```json\n{0}\n```", "Sure: {0} Hope it helps.", "[{0}, 2] as a list", "{{\"a\": [1, {0}], \"b\": \"}}\"", "no answer", "  {0}  ", "see ] and [x] {0}",
)

#: Endings of the hosts that are asked for, the last three under a wildcard and its exception.
ENDINGS = ("com", "co.uk", "com.co", "example", "ck", "city.ck", "www.ck", "kawasaki.jp", "a.kawasaki.jp", "city.kawasaki.jp")


def _forest(spark, d):
    p = F.col("p_partkey")
    return table(spark, d, "part").select(p.alias("id"), F.when(p % 11 != 0, F.floor(p / 4)).alias("parent"), F.col("p_name").alias("name"), F.col("p_size").alias("size_own"))


def e19_forest(spark, d):
    """Parts under one another by quarters of their number, in depth-first order by name."""
    got = hierarchy.toured(_forest(spark, d), "name", ("size_own",))
    return got.select("id", "root", "depth", "place", "size", F.col("size_own").cast("long").alias("whole"))


def _directory(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), F.col("s_name").alias("name"), (F.col("s_acctbal") < 0).alias("pinned"), F.when(k % 4 == 0, F.floor(k / 8)).alias("parent"))


def _answers(spark, d):
    """(o_orderkey, content): what a model might say of each order's suppliers; some of it is no JSON."""
    child, line = F.col("l_suppkey"), F.col("l_linenumber")
    parent = F.when((child % 3 == 0) & (line % 2 == 0), child.bitwiseXOR(F.lit(1))).when(child % 5 == 1, child + 7).otherwise(F.floor(child / 2))
    name = F.when(child % 7 == 2, F.concat(F.lit(" Holding "), (child % 4).cast("string"), F.lit(" S.A.S."))).when(child % 7 == 3, F.lit("")).when(child % 7 == 4, F.concat(F.lit("SUPPLIER#"), F.lpad((child + 1).cast("string"), 9, "0")))
    item = F.struct(child.alias("child_id"), F.when(child % 7 != 2, F.when(child % 7 != 4, parent)).cast("long").alias("parent_id"), name.alias("parent_name"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(line.alias("line"), F.col("l_partkey"), item.alias("item")))).alias("x"))
    content = F.to_json(F.struct(F.transform("x", lambda x: x["item"]).alias("links")))
    return rows.select("l_orderkey", F.when(F.col("l_orderkey") % 10 == 9, F.substring(content, F.lit(1), F.length(content) - 1)).otherwise(content).alias("content"))


def e30_links(spark, d):
    """Suppliers put under others by the answers' links, in order: what is linked, and to what."""
    items = _answers(spark, d).select("l_orderkey", F.posexplode(hierarchy.link_items(F.col("content"))).alias("pos", "x")).select((F.col("l_orderkey") * 100 + F.col("pos")).alias("idx"), "x.*")
    entries = _directory(spark, d)
    links, made = hierarchy.named_parents(items, entries, text.org_core)
    got = hierarchy.linked(entries.select("id", "parent").unionByName(made.select("id", F.lit(None).cast("long").alias("parent"))), links)
    names = entries.select(F.col("id").alias("parent"), "name").unionByName(made.select(F.col("id").alias("parent"), "name"))
    return got.join(names, "parent").select("idx", "child", "parent", F.trim("name").alias("parent_name"), "accepted")


MAIL_RULES = [
    rules.MailRule(1, "block", "sender_domain", " EN.example "), rules.MailRule(2, "allow", pattern="(the|der) [a-z]+ing", field="subject_or_body"), rules.MailRule(3, "block", "sender_email", "", "x", "body"),
    rules.MailRule(4, "allow", "list_id", "web", "^[a-m]", "subject"), rules.MailRule(5, "block", pattern="que|une", field="subject"), rules.MailRule(6, "allow"), rules.MailRule(7, "block", pattern="(a+)+", field="body"),
    rules.MailRule(8, "allow", "sender_domain", "de.example", "zz", "nowhere"),
]


def f15_mail_rules(spark, d):
    """Documents as mail from their language's domain, on the list of their source, under rules on sender and text."""
    docs = table(spark, d, "documents").withColumns({"_mail": F.concat(F.lit("A"), (F.col("doc_id") % 3).cast("string"), F.lit("@"), F.col("lang"), F.lit(".example")), "_subject": F.left("text", F.lit(60))})
    got = rules.mail_decided(docs, MAIL_RULES, email=F.col("_mail"), list_id=F.col("source"), subject=F.col("_subject"), body=F.col("text"))
    return got.select("doc_id", "block_id", "allow_id", "decision")


def f8_domains(spark, d):
    """Registrable domains of hosts with endings of every kind of rule."""
    ending = F.get(F.lit(list(ENDINGS)), (F.col("doc_id") % len(ENDINGS)).cast("int"))
    host = F.concat_ws(".", F.when(F.col("doc_id") % 3 == 0, "Mail").when(F.col("doc_id") % 3 == 1, "a.b"), F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("s"), (F.col("doc_id") % 17).cast("string"))), ending)
    rows = table(spark, d, "documents").select(F.lower(host).alias("host"), identifiers.registrable_domain(host).alias("domain"))
    return rows.groupBy("host", "domain").agg(F.count(F.lit(1)).alias("n"))


def f25_salvaged(spark, d):
    """The JSON in answers with fences, prose, brackets in strings, or none."""
    shape = F.get(F.lit([s.replace("{{", "{").replace("}}", "}") for s in SALVAGED]), (F.col("event_id") % len(SALVAGED)).cast("int"))
    content = F.replace(shape, F.lit("{0}"), F.col("props"))
    rows = events(spark, d).select("event_id", content.alias("content"))
    return rows.select("event_id", json_text.salvaged(F.col("content")).alias("json"), json_text.salvaged(F.col("content"), scan=True).alias("scanned"), F.coalesce(json_text.balanced(F.col("content")), F.lit("")).alias("balanced"))


def _modules(spark, d):
    """(name, dep, hard) among parts, and the active ones."""
    p, name = F.col("p_partkey"), lambda c: F.concat(F.lit("m"), c.cast("string"))
    parts = table(spark, d, "part")
    hard = parts.where("p_partkey >= 4").select(name(p).alias("name"), name(F.floor(p / 4)).alias("dep"), F.lit(True).alias("hard"))
    soft = parts.where("p_partkey >= 6").select(name(p).alias("name"), name(F.floor(p / 6)).alias("dep"), F.lit(False).alias("hard"))
    return hard.unionByName(soft), parts.where("p_size <> 17").select(name(p).alias("name"))


def _requests(spark, d):
    """(grp, name) chosen, by order, and what `_modules` says."""
    chosen = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("name"))
    return chosen, *_modules(spark, d)


def w15_order(spark, d):
    """What the parts of each order need, in an order in which it can run; null for what can't."""
    return dependencies.ordered(*_requests(spark, d))


def w16_packs(spark, d):
    """The same in packs of three, none with one's own dependency."""
    return dependencies.ordered_packs(*_requests(spark, d), 3)


def _jobs(spark, d):
    """A backfill of each user's events, from the first day to the one after the last, by days, weeks or months."""
    spans = events(spark, d).groupBy(F.col("user_id").alias("source")).agg(F.to_date(F.min("ts")).alias("range_start"), F.date_add(F.to_date(F.max("ts")), 1).alias("range_end"))
    return spans.withColumn("unit", F.when(F.col("source") % 3 == 0, "day").when(F.col("source") % 3 == 1, "week").otherwise("month"))


def w12_backfill(spark, d):
    """The windows of every user's backfill."""
    return ingest.job_windows(_jobs(spark, d))


def _results(spark, d):
    """What each window of a user brings; a window fails that has an error of more than 120."""
    rows = events(spark, d).select(F.col("user_id").alias("source"), F.to_date("ts").alias("day"), "event_type", "value")
    windows = ingest.job_windows(_jobs(spark, d))
    inside = windows.join(rows, "source").where("day >= window_start AND day < window_end")
    return inside.groupBy("source", "window_start", "window_end").agg(F.count(F.lit(1)).alias("posted"), (F.max(F.when(F.col("event_type") == "error", F.col("value"))) > 120).alias("failed"))


def w13_advanced(spark, d):
    """How far every backfill comes: twice, the second time the windows below four posts don't fail."""
    first = ingest.advanced_jobs(ingest.new_jobs(_jobs(spark, d)), _results(spark, d))
    again = _results(spark, d).withColumn("failed", F.col("failed") & (F.col("posted") >= 4))
    return ingest.advanced_jobs(first, again).select("source", "frontier", "status", "windows", "posted")


_SPLIT = "string_split(host, '.')"


def _f8_sql() -> str:
    rules = " UNION ALL ".join(f"SELECT '{w}' AS rule" for w in identifiers.PUBLIC_SUFFIXES.split())
    ending = f"['{chr(39) + ', ' + chr(39)}']".replace(f"'{chr(39)}, {chr(39)}'", ", ".join(f"'{e}'" for e in ENDINGS))
    return f"""WITH h AS (SELECT lower(concat_ws('.', CASE doc_id % 3 WHEN 0 THEN 'Mail' WHEN 1 THEN 'a.b' END, CASE WHEN doc_id % 4 <> 0 THEN 's' || doc_id % 17 END, ({ending})[doc_id % {len(ENDINGS)} + 1])) AS host FROM documents),
        c AS (SELECT host, n, {_SPLIT} AS l FROM (SELECT host, count(*) AS n FROM h GROUP BY 1)),
        t AS (SELECT host, l, unnest(range(1, len(l) + 1)) AS i FROM c), r AS ({rules}),
        m AS (SELECT host, l, max(CASE WHEN rule[1] = '!' THEN 1000 + len(l) - i ELSE len(l) - i + 1 END) AS best FROM t JOIN r ON
          rule = array_to_string(l[i:], '.') OR rule = '!' || array_to_string(l[i:], '.') OR rule = '*.' || array_to_string(l[i + 1:], '.') AND i < len(l) GROUP BY 1, 2)
        SELECT c.host, CASE WHEN best IS NULL THEN c.host WHEN best >= 1000 THEN array_to_string(c.l[-(best - 999):], '.') WHEN best >= len(c.l) THEN c.host ELSE array_to_string(c.l[-(best + 1):], '.') END AS domain, n
        FROM c LEFT JOIN m ON c.host = m.host"""


_SHAPES = "[" + ", ".join("'" + s.replace("{{", "{").replace("}}", "}").replace("'", "''") + "'" for s in SALVAGED) + "]"
_FIRST_OF = "CASE WHEN instr(t, '{0}') > 0 THEN instr(t, '{0}') ELSE length(t) + 1 END"
_OUTER = "CASE WHEN instr(t, '{0}') > 0 AND instr(t, '{1}') > 0 AND json_valid(substr(t, instr(t, '{0}'), length(t) - instr(reverse(t), '{1}') + 2 - instr(t, '{0}'))) THEN substr(t, instr(t, '{0}'), length(t) - instr(reverse(t), '{1}') + 2 - instr(t, '{0}')) END"
#: Of these shapes the first balanced piece, by what they hold.
_BALANCED = "CASE event_id % 8 WHEN 3 THEN '[' || props || ', 2]' WHEN 4 THEN '[1, ' || props || ']' WHEN 5 THEN '' WHEN 7 THEN '[x]' ELSE props END"
_MODULES = """deps AS (SELECT 'm' || p_partkey AS name, 'm' || p_partkey // 4 AS dep, true AS hard FROM part WHERE p_partkey >= 4 UNION ALL SELECT 'm' || p_partkey, 'm' || p_partkey // 6, false FROM part WHERE p_partkey >= 6),
    active AS (SELECT 'm' || p_partkey AS name FROM part WHERE p_size <> 17)"""
_ORDER = f"""WITH RECURSIVE {_MODULES},
    reach AS (SELECT name, name AS step FROM (SELECT 'm' || l_partkey AS name FROM lineitem UNION SELECT name FROM active) UNION SELECT reach.name, dep FROM reach JOIN deps ON hard AND deps.name = step),
    off AS MATERIALIZED (SELECT DISTINCT name FROM reach WHERE step NOT IN (SELECT name FROM active)),
    need AS (SELECT DISTINCT l_orderkey AS grp, 'm' || l_partkey AS name FROM lineitem UNION SELECT need.grp, dep FROM need JOIN deps ON hard AND deps.name = need.name AND need.name IN (SELECT name FROM active) AND dep IN (SELECT name FROM active)),
    needed AS MATERIALIZED (SELECT * FROM need), runs AS MATERIALIZED (SELECT * FROM needed WHERE name NOT IN (SELECT name FROM off)),
    own AS MATERIALIZED (SELECT r.grp, r.name, coalesce(list(DISTINCT d.dep) FILTER (o.name IS NOT NULL), []) AS before FROM runs r LEFT JOIN deps d ON d.name = r.name LEFT JOIN runs o ON o.grp = r.grp AND o.name = d.dep GROUP BY 1, 2),
    turns AS (SELECT grp, CAST([] AS VARCHAR[]) AS done, list({{'name': name, 'before': before}} ORDER BY name) AS rest FROM own GROUP BY 1 UNION ALL
      SELECT grp, list_append(done, f.name), list_filter(rest, lambda x: x.name <> f.name) FROM (SELECT *, list_filter(rest, lambda x: list_has_all(done, x.before))[1] AS f FROM turns WHERE len(rest) > 0)),
    orders_of AS MATERIALIZED (SELECT grp, unnest(done) AS name, CAST(unnest(range(len(done))) AS INTEGER) AS place FROM turns WHERE len(rest) = 0)"""
_SPANS = """SELECT user_id AS source, CAST(min(ts) AS DATE) AS range_start, CAST(max(ts) AS DATE) + 1 AS range_end, CASE user_id % 3 WHEN 0 THEN INTERVAL 1 DAY WHEN 1 THEN INTERVAL 7 DAY ELSE INTERVAL 1 MONTH END AS step FROM events GROUP BY 1"""
_WINDOWS = f"""SELECT source, CAST(range_start + step * i AS DATE) AS window_start, least(CAST(range_start + step * (i + 1) AS DATE), range_end) AS window_end, range_start, range_end
    FROM (SELECT *, unnest(range(range_end - range_start)) AS i FROM ({_SPANS})) WHERE CAST(range_start + step * i AS DATE) < range_end"""
_WON = f"""SELECT source, range_start, range_end, window_start, window_end, count(*) AS posted, coalesce(max(value) FILTER (event_type = 'error') > 120, false) AND count(*) >= 4 AS failed
    FROM ({_WINDOWS}) JOIN events ON user_id = source AND CAST(ts AS DATE) >= window_start AND CAST(ts AS DATE) < window_end GROUP BY ALL"""
_LINES = """SELECT l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS idx, l_orderkey, l_suppkey AS child, CASE WHEN l_suppkey % 7 IN (2, 4) THEN NULL
    WHEN l_suppkey % 3 = 0 AND l_linenumber % 2 = 0 THEN xor(l_suppkey, 1) WHEN l_suppkey % 5 = 1 THEN l_suppkey + 7 ELSE l_suppkey // 2 END AS parent,
    CASE l_suppkey % 7 WHEN 2 THEN 'holding ' || l_suppkey % 4 WHEN 4 THEN 'supplier ' || lpad(CAST(l_suppkey + 1 AS VARCHAR), 9, '0') END AS core FROM lineitem"""

SQL = {
    "e19_forest": """WITH RECURSIVE p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 <> 0 AND p_partkey > 0 THEN p_partkey // 4 END AS parent, p_name AS name, p_size FROM part),
        w AS (SELECT id, id AS root, 0::BIGINT AS depth, [(name, id)] AS way, [id] AS up FROM p WHERE parent IS NULL OR parent NOT IN (SELECT id FROM p) UNION ALL
          SELECT p.id, root, depth + 1, list_append(way, (p.name, p.id)), list_append(up, p.id) FROM p JOIN w ON p.parent = w.id),
        s AS (SELECT u AS id, count(*) AS size, sum(p_size) AS whole FROM (SELECT w.id, unnest(up) AS u FROM w) JOIN p USING (id) GROUP BY 1)
        SELECT id, root, depth, row_number() OVER (PARTITION BY root ORDER BY way) - 1 AS place, size, CAST(whole AS BIGINT) AS whole FROM w JOIN s USING (id)""",
    "e30_links": f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM supplier), x AS ({_LINES}),
        k AS (SELECT x.*, p.s_suppkey AS known FROM x JOIN supplier c ON c.s_suppkey = child LEFT JOIN supplier p ON p.s_suppkey = parent WHERE l_orderkey % 10 <> 9),
        f AS (SELECT idx, child, parent, core FROM k WHERE (known IS NOT NULL) <> (core IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY child ORDER BY idx) = 1),
        g AS (SELECT f.* FROM f JOIN supplier ON s_suppkey = child WHERE s_acctbal >= 0),
        c AS (SELECT core, first, (SELECT min(s_suppkey) FROM supplier WHERE replace(lower(s_name), '#', ' ') = core) AS found FROM (SELECT core, min(idx) AS first FROM g WHERE core IS NOT NULL GROUP BY 1)),
        made AS (SELECT core, (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY first) AS id FROM c WHERE found IS NULL),
        l AS MATERIALIZED (SELECT idx, child, coalesce(g.parent, found, made.id) AS parent, row_number() OVER (ORDER BY idx) AS turn FROM g LEFT JOIN c USING (core) LEFT JOIN made USING (core)),
        t AS (SELECT 0::BIGINT AS turn, (SELECT list(CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey // 8 END ORDER BY s_suppkey) FROM supplier WHERE s_suppkey >= (SELECT min(s_suppkey) FROM supplier)) AS up, NULL::BOOLEAN AS ok UNION ALL
          SELECT turn + 1, CASE WHEN good THEN list_concat(up[:child - low], [parent], up[child - low + 2:]) ELSE up END, good FROM (
            SELECT t.turn, t.up, l.child, l.parent, low, list_reduce(list_prepend(l.parent, range(300)), lambda v, i: CASE WHEN v IS NULL OR v = l.child THEN v ELSE up[v - low + 1] END) IS DISTINCT FROM l.child AS good
            FROM t JOIN l ON l.turn = t.turn + 1, (SELECT min(s_suppkey) AS low FROM supplier)))
        SELECT idx, child, parent, coalesce(s_name, 'Holding ' || child % 4 || ' S.A.S.') AS parent_name, ok AS accepted FROM l JOIN t USING (turn) LEFT JOIN supplier ON s_suppkey = parent""",
    "f15_mail_rules": """WITH m AS (SELECT doc_id, lang, source, lower(coalesce("text", '')) AS body, lower(coalesce("text"[:60], '')) AS subject FROM documents),
        b AS (SELECT doc_id, CAST(CASE WHEN lower(lang) = 'en' THEN 1 WHEN regexp_matches(subject, 'que|une') THEN 5 END AS INTEGER) AS block_id,
          CAST(CASE WHEN regexp_matches(subject, '(the|der) [a-z]+ing') OR regexp_matches(body, '(the|der) [a-z]+ing') THEN 2 WHEN lower(trim(source)) = 'web' AND regexp_matches(subject, '^[a-m]') THEN 4 END AS INTEGER) AS allow_id FROM m)
        SELECT *, CASE WHEN block_id IS NOT NULL AND allow_id IS NOT NULL THEN 'conflict' WHEN block_id IS NOT NULL THEN 'block' WHEN allow_id IS NOT NULL THEN 'allow' END AS decision FROM b""",
    "f8_domains": _f8_sql(),
    "f25_salvaged": f"""WITH r AS (SELECT event_id, props, replace(({_SHAPES})[event_id % {len(SALVAGED)} + 1], '{{0}}', props) AS content FROM events), c AS (SELECT *, trim(content, ' ' || chr(10)) AS t FROM r),
        o AS (SELECT *, CASE WHEN json_valid(t) THEN t WHEN {_FIRST_OF.format("{")} <= {_FIRST_OF.format("[")} THEN coalesce({_OUTER.format("{", "}")}, {_OUTER.format("[", "]")}) ELSE coalesce({_OUTER.format("[", "]")}, {_OUTER.format("{", "}")}) END AS found, {_BALANCED} AS balanced FROM c)
        SELECT event_id, coalesce(found, content) AS json, coalesce(found, CASE WHEN json_valid(balanced) THEN balanced END, content) AS scanned, balanced FROM o""",
    "w12_backfill": f"SELECT source, window_start, window_end FROM ({_WINDOWS})",
    "w13_advanced": f"""WITH w AS ({_WON}), f AS (SELECT source, range_end, coalesce(min(window_start) FILTER (failed), range_end) AS frontier FROM w GROUP BY 1, 2)
        SELECT source, frontier, CASE WHEN frontier = range_end THEN 'done' ELSE 'active' END AS status, (SELECT count(*) FROM ({_WINDOWS}) v WHERE v.source = f.source AND v.window_start < frontier) AS windows,
        CAST(coalesce((SELECT sum(posted) FROM w WHERE w.source = f.source AND window_start < frontier), 0) AS BIGINT) AS posted FROM f""",
    "w15_order": f"{_ORDER} SELECT grp, name, place FROM orders_of UNION ALL SELECT grp, name, NULL FROM needed WHERE name IN (SELECT name FROM off)",
    "w16_packs": f"""{_ORDER}, item AS MATERIALIZED (SELECT o.grp, o.name, o.place, (SELECT list(step) FROM reach WHERE reach.name = o.name AND step <> o.name) AS before FROM orders_of o),
        fill AS (SELECT grp, name, place, 0 AS pack, [name] AS held FROM item WHERE place = 0 UNION ALL
          SELECT i.grp, i.name, i.place, CASE WHEN shut THEN pack + 1 ELSE pack END, CASE WHEN shut THEN [i.name] ELSE list_append(held, i.name) END FROM (
            SELECT f.grp, f.place AS last, f.pack, f.held, j.name, j.place, len(held) >= 3 OR list_has_any(held, coalesce(j.before, [])) AS shut FROM fill f JOIN item j ON j.grp = f.grp AND j.place = f.place + 1) i)
        SELECT grp, name, place, pack FROM fill""",
}
QUERIES = {name: globals()[name] for name in SQL}
