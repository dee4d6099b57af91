"""Small fixtures with known results."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tracelake.functions import html, identifiers, moments, money, text
from tracelake.operators import graph, hierarchy, intervals, joins, rules
from tracelake.sources import mail, posts
from tracelake.streaming import live


def values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_names_and_identifiers(spark):
    names = ("Acme S.A.S.", "Unity Technologies", "Grupo Bolívar S.A.", "OpenAI, Inc.", "Oxford Spa")
    assert values(spark, *[text.org_core(F.lit(n)) for n in names]) == ["acme", "unity", "bolivar", "openai", "oxford spa"]
    mails = ("j.doe+promo@gmail.com", "JDoe@googlemail.com", "juan+work@empresa.com")
    assert values(spark, *[identifiers.email(F.lit(m)) for m in mails]) == ["jdoe@gmail.com", "jdoe@gmail.com", "juan@empresa.com"]
    assert values(spark, identifiers.phone(F.lit("300 123 4567"))) == ["+573001234567"]
    assert values(spark, *[identifiers.registrable_domain(F.lit(h)) for h in ("a.b.c.acme.com", "forums.bbc.co.uk")]) == ["acme.com", "bbc.co.uk"]
    assert values(spark, *[identifiers.is_role(F.lit(a)) for a in ("notifications@github.com", "no-reply@x.com", "info@acme.com")]) == [True, True, False]


def test_money_and_time(spark):
    usd = money.in_usd(F.lit(200000.0), F.lit("COP"))
    assert values(spark, usd, money.nearly_equal(F.lit(50.0), F.lit(52.5)), money.in_usd(F.lit(1.0), F.lit("XYZ"))) == [50.0, True, None]
    iso = ("PT1H30M", "P2DT1S", "P", "1H", "PT")
    assert values(spark, *[moments.duration_seconds(F.lit(x)) for x in iso]) == [5400, 172801, None, None, None]
    assert values(spark, *[moments.backoff_seconds(F.lit(n)) for n in (0, 3, 9)]) == [60, 480, 3600]
    assert [moments.granularity(h) for h in (1, 50, 200, None)] == ["minute", "hour", "day", "hour"]


def test_text_functions(spark):
    assert values(spark, text.cut_bytes(F.lit("aéé"), 4), text.cut_bytes(F.lit("ab"), 4)) == ["aé", "ab"]
    assert values(spark, *[text.size_label(F.lit(n)) for n in (5, 1536, 3 << 20)]) == ["5 B", "2 KB", "3 MB"]
    page = "<head><title>t</title></head><body><script>x()</script><p>One&nbsp;&amp; <b>two</b></p><br>three<!-- no --></body>"
    assert values(spark, html.stripped(F.lit(page))) == ["One & two\nthree"]
    signature = [text.set_signature(F.array(*map(F.lit, s))) for s in ("abc", "cab")]
    a, b = values(spark, *signature)
    assert a == b


def test_rule_language(spark):
    payload = '{"from": {"email": "a@x.com"}, "subject": "Hello", "n": 5}'
    row = spark.createDataFrame([(payload,)], "payload string")
    held = {
        (("from.email", "equals", "a@x.com"),): True, (("from", "equals", "a@x.com"),): False, (("subject", "in", ("Hi", "Hello")),): True,
        (("subject", "regex", "^He"),): True, (("subject", "prefix", "he"),): False, (("subject", "prefix", "He"), ("n", "equals", 5)): True, (): True,
        (("subject", "near", "He"),): False, (("absent", "equals", "x"),): False,
    }
    for scope, want in held.items():
        rule = rules.Rule(1, "ignore", {p: {op: list(v) if isinstance(v, tuple) else v} for p, op, v in scope})
        assert row.select(rules.matches(rule, F.col("payload"))).first()[0] is want, scope
    keep = rules.Rule(2, "keep", {"subject": {"equals": "Hello"}}, priority=9)
    kept, drops = rules.filtered(row, [rules.Rule(42, "ignore", {}), keep])
    assert kept.count() == 1 and drops.count() == 0
    assert rules.filtered(row, [rules.Rule(42, "ignore", {})])[1].collect()[0]["dropped"] == 1
    assert [rules.safe_pattern(p) for p in ("newsletter", "(a+)+", "A", r"\d", "a*", "(?=x)")] == [True, False, False, False, False, False]


def test_days_and_streaks(spark):
    day = lambda n: datetime.date(2026, 6, n)
    rows = spark.createDataFrame([("u", day(n), 1) for n in (1, 2, 3, 6)], "k string, day date, n int")
    got = sorted((r["start_day"].day, r["end_day"].day, r["days"], r["n"]) for r in intervals.merged_days(rows, ["k"], gap=2).collect())
    assert got == [(1, 6, 6, 4)]
    got = sorted((r["start_day"].day, r["end_day"].day, r["days"], r["n"]) for r in intervals.merged_days(rows, ["k"]).collect())
    assert got == [(1, 3, 3, 3), (6, 6, 1, 1)]
    habits = spark.createDataFrame([("a", day(8)), ("a", day(9)), ("a", day(10)), ("b", day(8)), ("b", day(9)), ("c", day(8)), ("c", day(10)), ("d", day(7))], "k string, day date")
    assert {r["k"]: r["streak"] for r in intervals.streaks(habits, ["k"], "2026-06-10").collect()} == {"a": 3, "b": 2, "c": 1, "d": 0}


def test_nearest_in_time(spark):
    t = lambda m: datetime.datetime(2026, 1, 1, 12, m)
    fixes = spark.createDataFrame([("u", t(0), 1), ("u", t(30), 2)], "k string, ts timestamp_ntz, lat int")
    probes = spark.createDataFrame([("u", t(10)), ("u", t(25)), ("u", t(15))], "k string, ts timestamp_ntz")
    near = lambda stale: {r["ts"].minute: r["near_lat"] for r in joins.nearest_in_time(probes, fixes, ["k"], "ts", ["lat"], stale).collect()}
    assert near(None) == {10: 1, 25: 2, 15: 1} and near(300) == {10: None, 25: 2, 15: None}


def test_communities_and_modularity(spark):
    triangles = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in triangles] + [(3, 4, 0.2), (8, 9, 1.0)], "a long, b long, weight double")
    members = graph.communities(edges)
    of = {r["id"]: r["community"] for r in members.collect()}
    assert of == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    value = graph.modularity(edges.where("a < 8"), members).first()["modularity"]
    assert value == pytest.approx(2 * (6 / 12.4 - (6.2 / 12.4) ** 2), abs=1e-5)


def test_louvain_against_label_propagation(spark):
    """On noisy groups Louvain's modularity is no less; a piece that is too large is split again."""
    import random

    rng = random.Random(3)
    edges = {(i, j): 1.0 + (i + j) % 3 for i in range(20) for j in range(i + 1, 20) if rng.random() < (0.8 if i // 5 == j // 5 else 0.08)}
    rows = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a long, b long, weight double").cache()
    found = graph.louvain(rows.selectExpr("a", "b", "weight", "0L AS part"))
    value = lambda m: graph.modularity(rows, m).first()["modularity"]
    assert value(found) >= value(graph.propagated(rows)) - 1e-9 and value(found) > 0.3


def test_matched_is_greedy(spark):
    import random

    rng = random.Random(1)
    groups = {g: set(rng.sample(range(30), rng.randint(1, 8))) for g in range(8)}
    children = {c: set(rng.sample(range(30), rng.randint(1, 8))) for c in range(9)}
    children[9] = groups[2]
    pairs = sorted((-len(x & y) / len(x | y), g, c) for g, x in groups.items() for c, y in children.items() if len(x & y) / len(x | y) >= 0.2)
    want, used = {}, set()
    for _, g, c in pairs:
        if g not in want and c not in used:
            want[g] = c
            used.add(c)
    frame = lambda sets, name: spark.createDataFrame([(k, i) for k, x in sets.items() for i in x], f"{name} long, id long")
    assert {r["group"]: r["child"] for r in graph.matched(frame(groups, "group"), frame(children, "child"), 0.2).collect()} == want


def test_hierarchy_with_a_cycle(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 6), (6, 5), (7, 6), (8, 99)], "id long, parent long")
    got = {r["id"]: (r["root"], r["depth"], r["cyclic"]) for r in hierarchy.placed(rows).collect()}
    assert got == {1: (1, 0, False), 2: (1, 1, False), 3: (1, 2, False), 4: (1, 3, False), 5: (None, None, True), 6: (None, None, True), 7: (None, None, True), 8: (99, 1, False)}


def test_mail_and_archives(spark):
    raw = b"From: Ann <Ann@X.com>\r\nTo: b@y.org\r\nSubject: =?utf-8?q?Caf=C3=A9?=\r\nDate: Mon, 01 Jan 2024 10:00:00 +0000\r\nMessage-ID: <1@x>\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>Hi&nbsp;<b>you</b></p>"
    old = raw.replace(b"2024", b"1984")
    got = {r["path"]: r for r in mail.messages(spark.createDataFrame([("a", raw), ("b", old), ("c", None)], "path string, content binary"), F.lit("2024-06-01").cast("timestamp")).collect()}
    assert (got["a"]["from_email"], got["a"]["subject"], got["a"]["body"], got["a"]["to"]) == ("ann@x.com", "Café", "Hi you", ["b@y.org"])
    assert got["a"]["occurred_at"].year == 2024 and got["b"]["occurred_at"].month == 6 and got["c"]["from_email"] is None
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "text")
        z.writestr("bomb.txt", "0" * 1_000_000)
    out = {r["name"]: r["refused"] for r in mail.unpacked(spark.createDataFrame([("z", data.getvalue()), ("x", b"no")], "path string, content binary")).collect()}
    assert out == {"a.txt": None, "bomb.txt": "too large", None: "broken"}


def test_posts_and_cursors(spark):
    payloads = ['{"id": "1", "caption": "hi", "ownerUsername": "u", "timestamp": "2024-01-02T03:04:05Z", "displayUrl": "p", "images": ["p", "q"]}', '{"id_str": "2", "full_text": "yo", "author": {"userName": "v"}, "createdAt": "Tue Jan 02 03:04:05 +0000 2024"}', "{}"]
    got = {r["post_id"]: r for r in posts.posts(spark.createDataFrame([(p,) for p in payloads], "payload string")).collect()}
    assert got["1"]["media"] == ["p", "q"] and got["1"]["posted_at"] == got["2"]["posted_at"] and got["2"]["account"] == "v" and got[None]["posted_at"] is None
    rows = spark.createDataFrame([("u", 1, "a"), ("u", 2, "b"), ("u", 2, "c"), ("v", 1, "d")], "account string, posted_at int, post_id string")
    cursors = spark.createDataFrame([("u", 2, "b")], "account string, seen_at int, seen_id string")
    assert sorted(r["post_id"] for r in posts.newer(rows, cursors).collect()) == ["c", "d"]
    assert {r["account"]: r["seen_id"] for r in posts.advanced(rows).collect()} == {"u": "c", "v": "d"}


def test_stream_ingests_each_key_once(spark, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    make = lambda ids: spark.createDataFrame([(i, '{"k": %d}' % i) for i in ids], "id long, payload string").coalesce(1).write.mode("append").parquet(folder)
    make([1, 2, 3])
    drop = [rules.Rule(1, "ignore", {"k": {"equals": 3}})]
    for more in ([3, 4, 2], []):
        live.ingested(live.stream(spark, folder, 1), target, ["id"], str(tmp_path / "state"), drop).awaitTermination()
        if more:
            make(more)
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [1, 2, 4]


def test_supervised_tries_again():
    class Query:
        def awaitTermination(self):
            calls.append(1)
            if len(calls) < 3:
                raise RuntimeError

    calls, pauses = [], []
    assert live.supervised(Query, wait=pauses.append) == 2 and pauses == [1.0, 2.0]
