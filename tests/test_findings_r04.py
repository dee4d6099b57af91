"""What the fourth review found, on tables small enough to say what is right."""

import random

import numpy as np
import pytest

from tests.test_findings_r03 import same_as_sql, write
from tests.test_queries import SF
from tracelake.operators import dependencies, graph
from tracelake.streaming import notices


def test_f2_notices_of_nobody_and_without_content(spark, tmp_path):
    """Events of no user, value, type or properties, and copies at the same times."""
    null = lambda c, n, r: f"CASE WHEN event_id % {n} <> {r} THEN {c} END AS {c}"
    odd = f"user_id % 4 AS user_id, {null('value', 3, 0)}, {null('props', 7, 1)}, {null('event_type', 11, 2)}"
    write(tmp_path, "events", f"SELECT e.* REPLACE (event_id + 1000 * i AS event_id, CASE WHEN event_id % 5 > 0 THEN user_id END AS user_id) FROM range(3) r(i), (SELECT * REPLACE ({odd}) FROM '{SF}/events.parquet') e WHERE event_id < 300")
    rows = same_as_sql(spark, "t10_notices", tmp_path, "events")
    assert any(r["user_id"] is None for r in rows)


def test_f5_a_batch_of_notices_is_one_shuffle_without_python(spark):
    ddl = "user_id long, dedup_key string, seq long, at timestamp, op string, content string, expires_at timestamp"
    actions = spark.createDataFrame([], ddl)
    plan = notices.queued(actions, spark.createDataFrame([], notices._STATE), 5)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Exchange") == 1


def planted(seed):
    """Two graphs without links between them, of four and three groups."""
    rng = random.Random(seed)
    return {(a, b): rng.randint(1, 6) / 2 for a in range(35) for b in range(a + 1, 35) if (a < 20) == (b < 20) and rng.random() < (0.9 if a // 5 == b // 5 else 0.1)}


def test_f1_pieces_that_fit_a_task_take_no_rounds(spark, monkeypatch):
    def rounds(*_):
        raise AssertionError("a small graph moved in rounds")

    monkeypatch.setattr(graph, "_moved", rounds)
    pairs = {(a, b): 1.0 for a in range(20) for b in range(a + 1, 20) if a // 5 == b // 5} | {(4, 5): 0.5, (14, 15): 0.5}
    edges = spark.createDataFrame([(a, b, w, 0) for (a, b), w in pairs.items()] + [(50, 51, 1.0, 7)], "a long, b long, weight double, part long")
    of = {r["id"]: r["community"] for r in graph.louvain(edges).collect()}
    assert of == {v: v // 5 * 5 for v in range(20)} | {50: 50, 51: 50}


@pytest.mark.parametrize("least", [1, 30, 80])
def test_f1_larger_pieces_move_in_rounds_first(spark, monkeypatch, least):
    """Pieces that are too large as they are, one of them, or both as long as communities aren't vertices."""
    monkeypatch.setattr(graph, "LOCAL_LINKS", least)
    rows = spark.createDataFrame([(a, b, w) for (a, b), w in planted(1).items()], "a long, b long, weight double").cache()
    found = graph.louvain(rows.selectExpr("a", "b", "weight", "0L AS part")).cache()
    of = {r["id"]: r["community"] for r in found.collect()}
    assert set(of) == set(range(35)) == {*range(35)} and found.count() == 35
    assert not {of[v] for v in range(20)} & {of[v] for v in range(20, 35)}
    value = lambda m: graph.modularity(rows, m).first()["modularity"]
    assert value(found) >= value(graph.propagated(rows)) - 1e-9 and value(found) > 0.3


def test_f1_no_community_gains_by_joining_another(monkeypatch):
    """The same from dicts and from arrays of communities, and no union of two communities has more modularity."""
    pairs = planted(5)
    a, b, w = (np.array(x) for x in zip(*[(x, y, w) for (p, q), w in pairs.items() for x, y in ((p, q), (q, p))], strict=True))
    degree = np.bincount(a, w)
    every = []
    for sparse in (0, 7, 99):
        monkeypatch.setattr(graph, "SPARSE", sparse)
        every.append(graph._found_alone(a, b, w, degree, w.sum(), 1.0))
    of = every[0]
    assert all((x == of).all() for x in every)
    share = lambda of: w[of[a] == of[b]].sum() / w.sum() - (np.bincount(of, degree) ** 2).sum() / w.sum() ** 2
    assert share(of) > 0.5
    assert all(share(np.where(of == c, d, of)) <= share(of) + 1e-9 for c in set(of) for d in set(of) if c != d)


def of_requests(spark, seed, rounds=False):
    """Names that depend on others, some of them lost, and requests, which name some that nobody knows."""
    rng, names = random.Random(seed), [f"m{k:02d}" for k in range(40)]
    deps = [(n, names[rng.randrange(k)], rng.random() < 0.7) for k, n in enumerate(names) if k for _ in range(2)] + [("m00", "m39", True)] * rounds
    chosen = [(g, n) for g in range(25) for n in [*rng.sample(names, 4), f"x{g % 3}", f"x{g % 2}"]]
    frames = (spark.createDataFrame(chosen, "grp long, name string"), spark.createDataFrame(deps, "name string, dep string, hard boolean"))
    return *frames, spark.createDataFrame([(n,) for n in names if rng.random() < 0.93 or rounds], "name string")


@pytest.mark.parametrize("sent", [0, 40, 1 << 23])
def test_f3_names_are_sent_or_go_with_a_choice(spark, monkeypatch, sent):
    """None, some and all of the names are sent to all tasks; places and packs are the same."""
    monkeypatch.setattr(dependencies, "SENT", sent)
    seen, plain = [], dependencies._shelf
    monkeypatch.setattr(dependencies, "_shelf", lambda items: seen.append(items.count()) or plain(items))
    chosen, deps, active = of_requests(spark, 4)
    orders = dependencies.ordered(chosen, deps, active).cache()
    got = {(r["grp"], r["name"]): r["place"] for r in orders.collect()}
    want, needs, live = {}, {}, {r["name"] for r in active.collect()}
    for r in deps.collect():
        needs.setdefault(r["name"], {}).setdefault(r["dep"], False)
        needs[r["name"]][r["dep"]] |= r["hard"]
    firm = lambda n: {d for d, hard in needs.get(n, {}).items() if hard}
    lost = lambda n: n not in live or any(map(lost, firm(n)))
    for g in range(25):
        items = set()
        todo = [r["name"] for r in chosen.where(f"grp = {g}").collect()]
        while todo:
            if (n := todo.pop()) not in items:
                items.add(n)
                todo += [d for d in firm(n) if n in live and d in live]
        want |= {(g, n): None for n in items if lost(n)}
        left, done = {n for n in items if not lost(n)}, []
        while left:
            done.append(min(n for n in left if not left & needs.get(n, {}).keys()))
            left -= {done[-1]}
        want |= {(g, n): k for k, n in enumerate(done)}
    assert got == want and len(seen) == 1 and (seen[0] > 0) == (sent > 0)
    two = dependencies.packed(orders, deps.where("hard").select("name", "dep"), 3).select("grp", "name", "place", "pack")
    one = dependencies.ordered_packs(chosen, deps, active, 3).select("grp", "name", "place", "pack")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) != []


@pytest.mark.parametrize("sent", [0, 1 << 23])
def test_f3_a_circle_is_still_an_error(spark, monkeypatch, sent):
    monkeypatch.setattr(dependencies, "SENT", sent)
    with pytest.raises(Exception, match="go round in a circle"):
        dependencies.ordered(*of_requests(spark, 4, rounds=True)).collect()


def test_f4_a_choice_is_shuffled_as_a_number(spark):
    plan = dependencies.ordered(*of_requests(spark, 5))._jdf.queryExecution().optimizedPlan().toString()
    assert "heads" not in plan and "deps" not in plan
