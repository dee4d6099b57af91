"""Queries over messages: ingestion, rules, relevance of senders, windows of work, page text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import html, text
from tracelake.operators import ingest, latest, metrics, rules
from tracelake.sources.tables import events, messages, table

CUTOFF = "2024-01-16 00:00:00"

RULES = [
    rules.Rule(1, "ignore", {"k": {"regex": "^9"}}, priority=5),
    rules.Rule(2, "keep", {"k": {"in": [91, 92]}}, priority=9),
    rules.Rule(3, "archive", {"k": {"prefix": "8"}}),
    rules.Rule(4, "ignore", {"k": {"equals": 7}}),
    rules.Rule(5, "ignore", {"k": {"near": 3}}, priority=50),  # no such operator: matches nothing
    rules.Rule(6, "ignore", {}, priority=99, enabled=False),
]


def a18_sender_stats(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.sum("n_chars").alias("chars"), F.count_distinct("lang").alias("langs")
    )


def _by_sender(spark, d):
    n, good = F.count(F.lit(1)), F.count_if(F.col("relevant"))
    return messages(spark, d).groupBy("sender").agg(
        n.alias("messages"), good.alias("relevant"), F.count_if(~F.col("relevant")).alias("inert"), F.count_if(F.col("relevant").isNull()).alias("unmarked"),
        metrics.ratio(good.cast("double"), n).alias("share"),
    )


def a21_sender_relevance(spark, d):
    """Messages of each sender by their marks, and their number against the mean."""
    rows = _by_sender(spark, d)
    mean = rows.agg(F.avg("messages").alias("mean"))
    return rows.crossJoin(F.broadcast(mean)).withColumn("volume", F.round(F.col("messages") / F.col("mean"), 6)).drop("mean")  # one row


def a22_sender_samples(spark, d):
    """Senders with five messages at least, and their three first ids."""
    docs = table(spark, d, "documents")
    first = latest.first_per_key(docs, ["source"], [F.col("doc_id")], 3).groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("sample"))
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").join(first, "source")


def a23_dry_run(spark, d):
    """What a rule on one language would hit."""
    got = rules.dry_run(messages(spark, d), F.col("lang") == "en", "relevant", "doc_id")
    return got.withColumn("sample_ids", F.array_join("sample_ids", ","))


def a24_candidates(spark, d):
    return _by_sender(spark, d).where("messages >= 5 AND share <= 0.2").select("sender", "messages", "relevant")


def a26_coverage(spark, d):
    rows = messages(spark, d)
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.count("relevant").alias("done"), metrics.ratio(F.count("relevant").cast("double"), F.count(F.lit(1))).alias("share"))


def a39_ordered_roles(spark, d):
    """The roles of each conversation's turns in order, as one string."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return turns.select("conv_id", F.array_join(F.transform("x", lambda t: t["role"]), ",").alias("roles"))


def i1_first_new(spark, d):
    """The first turn of each conversation that the table of marks lacks."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    marked = table(spark, d, "labels").select(F.col("doc_id").alias("conv_id"))
    return ingest.new_records(turns, marked, ["conv_id"], [F.col("turn")])


def i4_rule_actions(spark, d):
    return rules.decided(events(spark, d), RULES, payload="props").groupBy("rule_id", "action").agg(F.count(F.lit(1)).alias("n"))


def i6_rule_drops(spark, d):
    return rules.filtered(events(spark, d), RULES, payload="props")[1]


def i9_outcomes(spark, d):
    """One batch: broken if k is 95 or more, filtered by the rules, inserted if
    first of user and type, else a duplicate."""
    rows = events(spark, d).withColumn("broken", F.coalesce(F.get_json_object("props", "$.k").try_cast("long") >= 95, F.lit(False)))
    kept = rules.filtered(rows, RULES, payload="props")[0]
    new = latest.first_per_key(kept.where("NOT broken"), ["user_id", "event_type"], [F.col("event_id")])
    return ingest.outcomes(rows, kept, new, ["event_id"], F.col("broken"))


def i13_tiers(spark, d):
    """Tier by mail headers, here made from language and source."""
    docs = table(spark, d, "documents")
    header = F.to_json(
        F.struct(
            F.when(F.col("lang") == "en", F.col("source")).alias("list_id"), F.when(F.col("lang") == "fr", F.lit("Bulk")).alias("precedence"),
            F.when(F.col("n_chars") > 2000, F.lit("no")).alias("auto_submitted"),
        )
    )
    return docs.withColumn("tier", rules.tier(header)).groupBy("lang", "tier").agg(F.count(F.lit(1)).alias("n"))


def w3_unmarked(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return ingest.pending(docs, [table(spark, d, "labels")], "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def w7_windows(spark, d):
    """Windows of four turns; system turns go alone."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return ingest.count_windows(turns, "conv_id", ["turn"], 4, F.col("role") == "system").select("conv_id", "turn", "alone", "window_no")


def w20_merged_facts(spark, d):
    facts = table(spark, d, "documents").select("lang", "source", F.array("doc_id").alias("ids"))
    got = ingest.merged_facts(facts, {"lang": F.upper("lang"), "source": text.normalized(F.col("source"))}, "ids")
    return got.select("lang", "source", "merged", F.element_at("ids", 1).alias("first_id"), F.element_at("ids", -1).alias("last_id"))


def w21_forgotten(spark, d):
    """Facts per user and type without the events 0 to 199; those left without any go."""
    facts = events(spark, d).groupBy("user_id", "event_type").agg(F.sort_array(F.collect_list("event_id")).alias("ids"))
    return ingest.forgotten(facts, list(range(200)), "ids").select("user_id", "event_type", F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("first_id"))


def w22_dead_letters(spark, d):
    return ingest.dead_letters(events(spark, d).where("event_type = 'error'"), ["user_id"], 3)


def t9_retention(spark, d):
    """What stays if views and clicks before a day go."""
    rows = events(spark, d).where(~(F.col("event_type").isin("view", "click") & (F.col("ts") < F.lit(CUTOFF).cast("timestamp_ntz"))))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def s9_page_text(spark, d):
    """Digest and length of each page's text without markup."""
    got = table(spark, d, "pages").select("page_id", html.stripped(F.col("html")).alias("text"))
    return got.select("page_id", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def f7_hosts(spark, d):
    from tracelake.functions import identifiers

    host = identifiers.host(F.col("url"))
    return table(spark, d, "pages").groupBy(identifiers.registrable_domain(host).alias("domain"), host.alias("host")).agg(F.count(F.lit(1)).alias("n"))


def p9_has_mark(spark, d):
    """EXISTS as a column."""
    marked = table(spark, d, "labels").select("doc_id").distinct().withColumn("marked", F.lit(True))
    docs = table(spark, d, "documents").select("doc_id").join(marked, "doc_id", "left")
    return docs.select("doc_id", F.coalesce("marked", F.lit(False)).alias("marked"))


_K = "json_extract_string(props, '$.k')"
_RULE = f"""CASE WHEN {_K} IN ('91', '92') THEN 2 WHEN regexp_matches({_K}, '^9') THEN 1 WHEN starts_with({_K}, '8') THEN 3 WHEN {_K} = '7' THEN 4 END"""
_ACTION = "CASE rule_id WHEN 1 THEN 'ignore' WHEN 3 THEN 'archive' WHEN 4 THEN 'ignore' ELSE 'keep' END"
_MARKS = "SELECT doc_id, source AS sender, lang, quality = 1 AS relevant FROM documents LEFT JOIN labels USING (doc_id)"
_SENDERS = f"""SELECT sender, count(*) AS messages, count(*) FILTER (relevant) AS relevant, count(*) FILTER (NOT relevant) AS inert,
    count(*) FILTER (relevant IS NULL) AS unmarked, round(count(*) FILTER (relevant) / count(*), 6) AS share FROM ({_MARKS}) GROUP BY 1"""

SQL = {
    "a18_sender_stats": """SELECT source, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id, CAST(sum(n_chars) AS BIGINT) AS chars,
        count(DISTINCT lang) AS langs FROM documents GROUP BY 1""",
    "a21_sender_relevance": f"SELECT *, round(messages / avg(messages) OVER (), 6) AS volume FROM ({_SENDERS})",
    "a22_sender_samples": "SELECT source, count(*) AS n, array_to_string(list_slice(list_sort(list(doc_id)), 1, 3), ',') AS sample FROM documents WHERE source IS NOT NULL GROUP BY 1 HAVING count(*) >= 5",
    "a23_dry_run": f"""SELECT count(*) AS matched, count(*) FILTER (relevant) AS relevant, count(*) FILTER (NOT relevant) AS not_relevant,
        count(*) FILTER (relevant IS NULL) AS unverdicted, array_to_string(list_slice(list_sort(list(doc_id)), 1, 20), ',') AS sample_ids FROM ({_MARKS}) WHERE lang = 'en'""",
    "a24_candidates": f"SELECT sender, messages, relevant FROM ({_SENDERS}) WHERE messages >= 5 AND share <= 0.2",
    "a26_coverage": f"SELECT lang, count(*) AS total, count(relevant) AS done, round(count(relevant) / count(*), 6) AS share FROM ({_MARKS}) GROUP BY 1",
    "a39_ordered_roles": "SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS roles FROM conversations GROUP BY 1",
    "i1_first_new": """SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1""",
    "i4_rule_actions": f"SELECT rule_id, {_ACTION} AS action, count(*) AS n FROM (SELECT {_RULE} AS rule_id FROM events) GROUP BY 1, 2",
    "i6_rule_drops": f"SELECT rule_id, count(*) AS dropped FROM (SELECT {_RULE} AS rule_id FROM events) WHERE rule_id IN (1, 4) GROUP BY 1",
    "i9_outcomes": f"""WITH r AS (SELECT *, coalesce(TRY_CAST({_K} AS BIGINT) >= 95, false) AS broken, coalesce({_RULE} IN (1, 4), false) AS dropped FROM events),
        f AS (SELECT event_id FROM r WHERE NOT broken AND NOT dropped QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1)
        SELECT count(*) AS posted, count(*) FILTER (NOT broken AND NOT dropped AND event_id IN (SELECT event_id FROM f)) AS inserted,
        count(*) FILTER (NOT broken AND NOT dropped AND event_id NOT IN (SELECT event_id FROM f)) AS duplicates,
        count(*) FILTER (NOT broken AND dropped) AS filtered, count(*) FILTER (broken) AS errors FROM r""",
    "i13_tiers": "SELECT lang, CASE WHEN (lang = 'en' AND source IS NOT NULL) OR lang = 'fr' THEN 'blacklist' ELSE 'batch' END AS tier, count(*) AS n FROM documents GROUP BY 1, 2",
    "w3_unmarked": "SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) GROUP BY 1",
    "w7_windows": """SELECT conv_id, turn, alone, CASE WHEN alone THEN rn ELSE rn // 4 END AS window_no FROM (
        SELECT conv_id, turn, role = 'system' AS alone, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn) - 1 AS rn FROM conversations)""",
    "w20_merged_facts": "SELECT upper(lang) AS lang, lower(trim(source)) AS source, count(*) AS merged, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1, 2",
    "w21_forgotten": "SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_id FROM events WHERE event_id >= 200 GROUP BY 1, 2",
    "w22_dead_letters": "SELECT user_id, count(*) AS attempts, CASE WHEN count(*) >= 3 THEN 'review' ELSE 'retry' END AS status FROM events WHERE event_type = 'error' GROUP BY 1",
    "t9_retention": f"""SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events
        WHERE NOT (event_type IN ('view', 'click') AND ts < TIMESTAMP '{CUTOFF}') GROUP BY 1""",
    "s9_page_text": f"SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, {html.stripped_sql('html')} AS t FROM pages)",
    "f7_hosts": r"""SELECT CASE WHEN last2 IN ('co.uk', 'com.co') THEN last3 ELSE last2 END AS domain, host, count(*) AS n FROM (
        SELECT host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS last2, array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') AS last3 FROM (
          SELECT regexp_replace(regexp_extract(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '^([^/?#:]*)', 1), '^www\.', '') AS host FROM pages)) GROUP BY 1, 2""",
    "p9_has_mark": "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AS marked FROM documents",
}
QUERIES = {name: globals()[name] for name in SQL}
