"""Hierarchies, links, dependencies, domains, JSON in text and backfills against plain versions."""

import datetime
import heapq
import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tracelake.functions import identifiers, json_text, text
from tracelake.operators import dependencies, hierarchy, ingest, places


def one_by_one(parents, links):
    """Links put in one after another; whether each was."""
    up, out = dict(parents), {}
    for idx, child, parent in sorted(links):
        at, seen = parent, set()
        while at is not None and at != child and at not in seen:
            seen.add(at)
            at = up.get(at)
        out[idx] = at != child
        if out[idx]:
            up[child] = parent
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_as_if_put_in_one_by_one(spark, seed):
    rng, n = random.Random(seed), 60
    parents = [(k, rng.randrange(k) if k and rng.random() < 0.6 else None) for k in range(n)]
    links = [(i, child, rng.randrange(n + 5)) for i, child in enumerate(rng.sample(range(n), 50))]
    got = hierarchy.linked(spark.createDataFrame(parents, "id long, parent long"), spark.createDataFrame(links, "idx long, child long, parent long"))
    assert {r["idx"]: r["accepted"] for r in got.collect()} == one_by_one(parents, links)


def test_a_way_back_over_a_parent_that_goes_later(spark):
    """2 is under 1 until the second link moves it, so the first one closes a circle."""
    parents = spark.createDataFrame([(1, None), (2, 1), (3, None)], "id long, parent long")
    links = spark.createDataFrame([(0, 1, 2), (1, 2, 3), (2, 3, 3)], "idx long, child long, parent long")
    assert {r["idx"]: r["accepted"] for r in hierarchy.linked(parents, links).collect()} == {0: False, 1: True, 2: False}


def test_link_items_of_an_answer(spark):
    answers = [
        '{"links": [{"child_id": 1, "parent_id": 2}, {"child_id": "3", "parent_id": 2}, {"child_id": 4, "parent_name": " Acme S.A. ", "cleaned_name": ""}, 5, {"child_id": true}]}',
        "no json", '{"links": 3}', '[1]', None,
    ]
    rows = spark.createDataFrame([(k, a) for k, a in enumerate(answers)], "k int, a string").orderBy("k").select(hierarchy.link_items(F.col("a")).alias("x")).collect()
    assert [tuple(x) for x in rows[0]["x"]][:3] == [(1, 2, None, None), (None, 2, None, None), (4, None, "Acme S.A.", None)]
    assert all(x["child_id"] is None for x in rows[0]["x"][3:]) and [r["x"] for r in rows[1:]] == [[], [], [], []]


def test_parents_by_id_or_by_name(spark):
    entries = spark.createDataFrame([(1, "Acme S.A.S.", False), (2, "Beta", True), (3, "Gamma", None), (4, "Delta", False), (5, "S.A.S.", False), (6, "Omega", False)], "id long, name string, pinned boolean")
    items = [
        (0, 9, 1, None), (1, 3, 1, "Both"), (2, 3, None, "ACME"), (3, 3, 4, None), (4, 2, None, "New one"), (5, 4, 77, " New  Co. "), (6, 5, None, "new co"), (7, 6, None, "S.A.S."),
        (8, 1, 77, None), (9, 1, 6, ""),
    ]
    links, made = hierarchy.named_parents(spark.createDataFrame(items, "idx long, child_id long, parent_id long, parent_name string"), entries, text.org_core)
    # 3: the first item that counts, by the company's core; 2 is pinned; 4 and 5 share a new parent; a legal form alone is no name to be found
    assert sorted(map(tuple, links.collect())) == [(2, 3, 1), (5, 4, 7), (6, 5, 7), (7, 6, 8), (9, 1, 6)]
    assert sorted(map(tuple, made.collect())) == [(7, " New  Co. "), (8, "S.A.S.")]


def test_forest_equals_a_plain_walk(spark):
    rng = random.Random(5)
    rows = [(k, rng.randrange(k) if k and rng.random() < 0.9 else None, rng.choice("abc"), rng.randrange(10)) for k in range(120)] + [(200, 201, "x", 1), (201, 200, "x", 1), (202, 201, "x", 1)]
    kids = {}
    for i, parent, name, _ in rows:
        kids.setdefault(parent, []).append((name, i))
    want = {}

    def walk(i, root, depth, place):
        own = next(r[3] for r in rows if r[0] == i)
        size, total = 1, own
        for _, k in sorted(kids.get(i, [])):
            s, t = walk(k, root, depth + 1, place + size)
            size, total = size + s, total + t
        want[i] = (root, depth, place, size, float(total))
        return size, total

    for _, i in kids[None]:
        walk(i, i, 0, 0)
    got = hierarchy.toured(spark.createDataFrame(rows, "id long, parent long, name string, v int"), "name", ("v",))
    assert {r["id"]: tuple(r)[1:] for r in got.collect()} == want


def test_a_long_chain_is_walked_in_few_rounds(spark):
    n = 20_000
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit("x").alias("name"))
    got = hierarchy.toured(chain, "name").agg(F.count(F.lit(1)), F.sum((F.col("depth") == F.col("id")).cast("int")), F.sum((F.col("size") == n - F.col("id")).cast("int"))).first()
    assert tuple(got) == (n, n, n)


def test_first_balanced_piece_and_salvage(spark):
    cases = {
        '```json\n{"a": 1}\n```': '{"a": 1}', 'Sure! [{"a": 1}, {"b": 2}] Done.': '[{"a": 1}, {"b": 2}]', ' {"x": "a } b"} ': '{"x": "a } b"}', "nothing here": "nothing here", '{"a": 1} and {"b": 2}': '{"a": 1} and {"b": 2}',
        '{"a": 1} trailing }': '{"a": 1} trailing }', "[1, 2": "[1, 2", "": "", "true": "true", '{"a": 1}, {"b": 2}': '{"a": 1}, {"b": 2}', "1,0] x": "1,0] x", '{"broken": ] } [1]': "[1]",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", json_text.salvaged(F.col("t")).alias("got"), json_text.salvaged(F.col("t"), True).alias("scanned"), json_text.balanced(F.col("t")).alias("b")).collect()
    assert {r["t"]: r["got"] for r in rows} == cases
    by = {r["t"]: r for r in rows}
    assert by['{"a": 1} and {"b": 2}']["scanned"] == '{"a": 1}' and by['{"a": 1} trailing }']["scanned"] == '{"a": 1}'
    odd = {'x {"q": "\\"}", "r": [1]} y': '{"q": "\\"}", "r": [1]}', '{ "open": [1, {"k": 2}]': '[1, {"k": 2}]', "(]) {}": "{}", '"{" {"a": "[" }': None}
    got = spark.createDataFrame([(k,) for k in odd], "t string").select("t", json_text.balanced(F.col("t")).alias("b")).collect()
    assert {r["t"]: r["b"] for r in got} == odd
    plan = spark.createDataFrame([("x",)], "t string").select(json_text.salvaged(F.col("t"), True))._jdf.queryExecution().toString()
    assert "Python" not in plan


@pytest.mark.parametrize("rules", [None, identifiers.suffix_rules("// a list\ncom\nuk\nco.uk\n*.ck\n!www.ck\n*.kawasaki.jp\n!city.kawasaki.jp\njp\n")])
def test_registrable_domains(spark, rules):
    cases = {
        "mail.acme.com": "acme.com", "ACME.com.": "acme.com.", "forums.bbc.co.uk": "bbc.co.uk", "co.uk": "co.uk", "com": "com", "": "", "localhost": "localhost", "10.0.0.1": "10.0.0.1", "a.b.internal": "a.b.internal",
        "x.y.foo.ck": "y.foo.ck", "foo.ck": "foo.ck", "www.ck": "www.ck", "a.www.ck": "www.ck", "a.b.c.kawasaki.jp": "b.c.kawasaki.jp", "a.city.kawasaki.jp": "city.kawasaki.jp", "a.b.jp": "b.jp",
    }
    cases["ACME.com."] = "acme.com"
    rows = spark.createDataFrame([(k,) for k in cases], "h string").select("h", identifiers.registrable_domain(F.col("h"), rules).alias("d")).collect()
    assert {r["h"]: r["d"] for r in rows} == cases


def plain_order(chosen, hard, soft, active):
    """Closure over active names, drops, then always the least name that can run."""
    need, stack, bad = set(chosen), [c for c in chosen if c in active], {c for c in chosen if c not in active}
    while stack:
        name = stack.pop()
        for dep in hard.get(name, ()):
            if dep not in active:
                bad.add(name)
            elif dep not in need:
                need.add(dep)
                stack.append(dep)
    while more := {n for n in need - bad if n in active and bad & set(hard.get(n, ()))}:
        bad |= more
    left = {n: {d for d in (*hard.get(n, ()), *soft.get(n, ())) if d in need - bad} for n in need - bad}
    order, ready = [], sorted(n for n, deps in left.items() if not deps)
    while ready:
        name = heapq.heappop(ready)
        order.append(name)
        for n, deps in left.items():
            if name in deps:
                deps.remove(name)
                if not deps:
                    heapq.heappush(ready, n)
    return order, bad, len(order) == len(left)


def test_orders_and_packs_of_random_requests(spark):
    rng = random.Random(8)
    names = [f"m{k:02d}" for k in range(30)]
    hard = {n: [names[j] for j in rng.sample(range(k), min(k, 2)) if rng.random() < 0.7] for k, n in enumerate(names)}
    soft = {n: [names[rng.randrange(k)]] for k, n in enumerate(names) if k and rng.random() < 0.4}
    active = {n for n in names if rng.random() < 0.9}
    requests = {g: rng.sample([*names, "other"], 4) for g in range(25)}
    deps = [(n, x, True) for n, v in hard.items() for x in v] + [(n, x, False) for n, v in soft.items() for x in v]
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    got = dependencies.ordered(frame([(g, n) for g, v in requests.items() for n in v], "grp long, name string"), frame(deps, "name string, dep string, hard boolean"), frame([(n,) for n in active], "name string"))
    rows = got.collect()
    for g, chosen in requests.items():
        order, bad, whole = plain_order(chosen, hard, soft, active)
        assert whole
        assert [r["name"] for r in sorted((r for r in rows if r["grp"] == g and r["place"] is not None), key=lambda r: r["place"])] == order
        assert {r["name"] for r in rows if r["grp"] == g and r["place"] is None} == bad
    packs = dependencies.packed(frame(rows, "grp long, name string, place int"), frame([x[:2] for x in deps if x[2]], "name string, dep string"), 3).collect()

    def behind(name):
        out = set()
        for x in hard.get(name, ()):
            out |= {x} | behind(x)
        return out

    for g in requests:
        want, pack = {}, []
        for r in sorted((r for r in rows if r["grp"] == g and r["place"] is not None), key=lambda r: r["place"]):
            if pack and (len(pack) >= 3 or behind(r["name"]) & set(pack)):
                pack = []
            number = (max(want.values()) if want else 0) + (1 if want and not pack else 0)
            pack.append(r["name"])
            want[r["name"]] = number
        assert {r["name"]: r["pack"] for r in packs if r["grp"] == g} == want


def test_cycles_are_reported(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "x"), ("d", "a"), ("d", "c")], "name string, dep string")
    levels, left = dependencies.peeled(edges)
    assert {r["name"]: r["level"] for r in levels.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert sorted(map(tuple, left.collect())) == [("x", "y"), ("y", "x"), ("z", "x")]
    chosen, active = spark.createDataFrame([(1, "x")], "grp long, name string"), spark.createDataFrame([("x",), ("y",)], "name string")
    with pytest.raises(Exception, match="in a circle in 1"):
        dependencies.ordered(chosen, edges.withColumn("hard", F.lit(True)), active).collect()


def test_backfill_stops_at_a_failure_and_goes_on_from_it(spark):
    jobs = spark.createDataFrame([(1, "2024-01-31", "2024-06-10", "month"), (2, "2024-01-01", "2024-01-04", "day"), (3, "2024-01-01", "2024-01-01", "week")], "source long, a string, b string, unit string")
    jobs = jobs.select("source", F.to_date("a").alias("range_start"), F.to_date("b").alias("range_end"), "unit")
    windows = [(str(r["window_start"]), str(r["window_end"])) for r in ingest.job_windows(jobs).where("source = 1").orderBy("window_start").collect()]
    assert windows == [("2024-01-31", "2024-02-29"), ("2024-02-29", "2024-03-31"), ("2024-03-31", "2024-04-30"), ("2024-04-30", "2024-05-31"), ("2024-05-31", "2024-06-10")]
    ran = lambda failed: spark.createDataFrame([(1, "2024-02-29", 5, True in failed), (1, "2024-01-31", 7, False), (1, "2024-04-30", 2, False), (2, "2024-01-02", 3, False)], "source long, w string, posted long, failed boolean").withColumn("window_start", F.to_date("w"))
    state = lambda df: {r["source"]: (str(r["frontier"]), r["status"], r["windows"], r["posted"]) for r in df.collect()}
    first = ingest.advanced_jobs(ingest.new_jobs(jobs), ran([True]))
    assert state(first) == {1: ("2024-02-29", "active", 1, 7), 2: ("2024-01-04", "done", 3, 3), 3: ("2024-01-01", "done", 0, 0)}
    assert state(ingest.advanced_jobs(first, ran([]))) == {1: ("2024-06-10", "done", 5, 14), 2: ("2024-01-04", "done", 3, 3), 3: ("2024-01-01", "done", 0, 0)}


def test_answers_are_json(spark):
    """What the link query makes of the answers is what Python's parser makes of them."""
    from tracelake.plans import directory

    rows = directory._answers(spark, "/root/testdata/sf0.001").select("content", hierarchy.link_items(F.col("content")).alias("x")).collect()
    for r in rows:
        try:
            want = json.loads(r["content"])["links"]
        except ValueError:
            want = []
        assert [(x["child_id"], x["parent_id"]) for x in r["x"]] == [(x.get("child_id"), x.get("parent_id")) for x in want]


def test_names_in_their_compatible_form(spark):
    words = ["Café ﬁn ½ Ⅷ Ångström ĳ ǅ 𝔘 가나", "plain", "İSTANBUL", "ß ø æ", "x̧́y", "①②", ""]
    rows = spark.createDataFrame([(w,) for w in words], "t string").select("t", text.unmarked(F.col("t")).alias("u"), text.match_key(F.col("t")).alias("k")).collect()
    for r in rows:
        assert r["u"] == "".join(c for x in r["t"] for c in (x if 0xAC00 <= ord(x) < 0xD7A4 else unicodedata.normalize("NFKD", x)) if not unicodedata.combining(c))
    assert {r["t"]: r["k"] for r in rows}["İSTANBUL"] == "istanbul"
    names = {"Acme Holdings PLC": "acme", "Kabushiki K.K.": "kabushiki", "Müller & Co. KG": "muller", "Grupo Éxito S.A.C.": "exito", "Oxford Spa": "oxford spa"}
    assert {r["n"]: r["c"] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", text.org_core(F.col("n")).alias("c")).collect()} == names
    roles = {"bounces+7@x.com": True, "notify@x.com": True, "jo.newsletter@x.com": False, "no_reply@x.com": True, "ann@x.com": False}
    assert {r["a"]: r["r"] for r in spark.createDataFrame([(a,) for a in roles], "a string").select("a", identifiers.is_role(F.col("a")).alias("r")).collect()} == roles


def test_places_of_transactions(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    tx = [
        (1, 7, at(100), "cafe lunar", True, None), (2, 7, at(5000), "x", True, False), (3, 7, at(1000), "y", False, None), (4, 8, at(100), "z", True, None), (5, 7, at(110), "w", True, True), (6, 7, at(2010), "far", True, None),
        (7, 7, at(4000), "still", True, None), (8, None, None, None, None, None),
    ]
    fixes = [(7, at(90), 4.00005, -74.0), (7, at(300), 4.0001, -74.0), (7, at(2000), 4.5, -74.0), (7, at(4100), 4.5, -74.0)]
    cells = [("4.0000", "-74.0000", "Café Lunar Bogotá")]
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    got = places.enriched(
        frame(tx, "id long, user long, at timestamp_ntz, place string, exact boolean, done boolean"), frame(fixes, "user long, at timestamp_ntz, lat double, lng double"),
        frame(cells, "lat string, lng string, name string").select(F.col("lat").cast("decimal(18,4)").alias("lat"), F.col("lng").cast("decimal(18,4)").alias("lng"), "name"), 600,
    ).collect()
    assert {r["id"]: tuple(r)[2:] for r in got} == {
        1: ("resolved", "Café Lunar Bogotá", "cafe lunar", True), 2: ("no_fix", "x", None, None), 3: ("skipped", "y", None, None), 4: ("no_fix", "z", None, None), 5: ("skipped", "w", None, None),
        6: ("in_transit", "far", None, None), 7: ("no_result", "still", None, None), 8: ("skipped", None, None, None),
    }
