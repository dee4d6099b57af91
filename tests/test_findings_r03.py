"""What the third review found, on tables small enough to say what is right."""

import random

import duckdb
import numpy as np
import pytest

from tests.test_queries import SF, rows_of
from tracelake import shared, store
from tracelake.operators import clusters, dependencies, graph, hierarchy, identity
from tracelake.plans import registry


def same_as_sql(spark, name, folder, *tables):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    got, want = registry.QUERIES[name](spark, str(folder)), con.sql(registry.ORACLE_SQL[name])
    rows = rows_of(got.columns, got.collect())
    assert rows == rows_of(want.columns, want.fetchall())
    return [dict(zip(sorted(got.columns), r, strict=True)) for r in rows]


def write(folder, table, select):
    duckdb.connect().execute(f"SET TimeZone = 'UTC'; COPY ({select}) TO '{folder}/{table}.parquet'")


def test_f1_needs_are_followed_once_a_name(spark, monkeypatch):
    followed, plain = [], dependencies.closure
    monkeypatch.setattr(dependencies, "closure", lambda chosen, deps: followed.append(chosen.count()) or plain(chosen, deps))
    chosen = spark.createDataFrame([(g, "c") for g in range(50)], "grp long, name string")
    deps = spark.createDataFrame([("c", "b", True), ("b", "a", True), ("a", "z", False)], "name string, dep string, hard boolean")
    active = spark.createDataFrame([(n,) for n in "abcz"], "name string")
    rows = dependencies.ordered(chosen, deps, active).collect()
    assert sorted(map(tuple, rows)) == [(g, n, k) for g in range(50) for k, n in enumerate("abc")]
    assert followed == [1]


def test_f3_one_pass_packs_like_two(spark):
    rng = random.Random(3)
    names = [f"m{k:02d}" for k in range(24)]
    deps = [(n, names[rng.randrange(k)], rng.random() < 0.7) for k, n in enumerate(names) if k for _ in range(2)]
    chosen = spark.createDataFrame([(g, n) for g in range(20) for n in rng.sample(names, 5)], "grp long, name string")
    deps, active = spark.createDataFrame(deps, "name string, dep string, hard boolean"), spark.createDataFrame([(n,) for n in names if rng.random() < 0.9], "name string")
    orders = dependencies.ordered(chosen, deps, active)
    two = dependencies.packed(orders, deps.where("hard").select("name", "dep"), 3).select("grp", "name", "place", "pack")
    one = dependencies.ordered_packs(chosen, deps, active, 3).select("grp", "name", "place", "pack")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) != []


def test_f4_numbers_of_more_than_five_digits(spark, tmp_path):
    write(tmp_path, "customer", "SELECT k AS c_custkey, CAST(k % 20 AS INTEGER) AS c_nationkey, 'X' AS c_mktsegment FROM (VALUES (7::BIGINT), (99999), (100000), (1234567)) t(k)")
    rows = same_as_sql(spark, "f5_identifiers", tmp_path, "customer")
    assert {r["c_custkey"]: r["phone"] for r in rows} == {7: "+573001200007", 99999: "+573001299999", 100000: "3001210000", 1234567: "3001212345"}


def test_f5_later_numbers_at_earlier_times(spark, tmp_path):
    write(tmp_path, "events", f"SELECT e.* REPLACE (event_id + 1000 * i AS event_id, user_id + 10 * (i % 2) AS user_id) FROM range(3) r(i), '{SF}/events.parquet' e WHERE event_id < 200")
    assert same_as_sql(spark, "t10_notices", tmp_path, "events")


@pytest.mark.parametrize("name", ["r12_incident", "r13_weights"])
def test_large_orders_are_paired(spark, tmp_path, name):
    """An order of nine suppliers has 36 pairs."""
    write(tmp_path, "lineitem", "SELECT 1::BIGINT AS l_orderkey, k AS l_suppkey, 'R' AS l_returnflag, 'F' AS l_linestatus FROM range(9) t(k)")
    assert len(same_as_sql(spark, name, tmp_path, "lineitem")) == {"r12_incident": 9, "r13_weights": 36}[name]


def test_f2_one_pass_says_moves_and_modularity(spark):
    rng = random.Random(2)
    pairs = {(a, b): rng.randint(1, 5) / 2 for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.5}
    two_m, of = 2 * sum(pairs.values()), {v: v % 3 for v in range(12)}
    both = [(a, b, w) for (x, y), w in pairs.items() for a, b, w in ((x, y, w), (y, x, w))]
    degree = {v: sum(w for a, _, w in both if a == v) for v in of}
    links, nodes = spark.createDataFrame(both, "id long, other long, weight double"), spark.createDataFrame([(v, d, two_m) for v, d in degree.items()], "id long, degree double, two_m double")
    seen, quality, gains = graph._seen(links, nodes, spark.createDataFrame(list(of.items()), "id long, community long"), 1.0)
    shares = [sum(d for v, d in degree.items() if of[v] == c) / two_m for c in range(3)]
    assert quality == pytest.approx(sum(w for a, b, w in both if of[a] == of[b]) / two_m - sum(s * s for s in shares))
    assert gains == seen.where("own <> to").count()


def test_f3_requests_are_ordered_together(monkeypatch):
    """Places and packs of all requests of a batch from one call, as of a heap for each."""
    rng, most = random.Random(33), 3
    requests = []
    for size in (1, 4, 30, 0, 90, 12):
        lost = {k for k in range(size) if rng.random() < 0.1}
        needs = {k: rng.sample(range(k), min(k, rng.randrange(4))) for k in range(size)}
        names = rng.sample(range(1000), size)
        requests.append({names[k]: (-1, []) if k in lost else (rng.randint(0, len(needs[k])), [names[d] for d in needs[k]] + [1000]) for k in range(size)})
    want = {}
    for g, items in enumerate(requests):
        done, pack, held, reach = [], 0, [], {}
        while free := [n for n, (h, d) in items.items() if h >= 0 and n not in done and all(x in done for x in d if x in items and items[x][0] >= 0)]:
            n = min(free)
            h, d = items[n]
            reach[n] = {y for x in d[:h] if x in reach for y in (x, *reach[x])}
            if len(held) >= most or reach[n] & set(held):
                pack, held = pack + 1, []
            want[g, n] = (len(done), pack, False)
            held.append(n)
            done.append(n)
        want |= {(g, n): (-1, -1, True) for n, (h, _) in items.items() if h < 0}
    rows = [(g, n, h, d) for g, items in enumerate(requests) for n, (h, d) in [*items.items(), *list(items.items())[:2]]]
    heads = np.array([(n, h, len(d) - max(h, 0)) for _, n, h, d in rows])
    group, deps = np.array([g for g, *_ in rows]), np.array([x for *_, d in rows for x in d])
    for cells in (1, 100, 1 << 22):
        monkeypatch.setattr(dependencies, "CELLS", cells)
        first, *got = dependencies._least_first(group, heads, deps, most)
        assert {(int(group[i]), int(heads[i, 0])): (int(p), int(k), bool(o)) for i, p, k, o in zip(first, *got, strict=True)} == want
    _, place, _, lost = dependencies._least_first(np.array([0, 0]), np.array([[1, 1, 0], [2, 0, 1]]), np.array([2, 1]), most)
    assert (place < 0).all() and not lost.any()


def test_f8_pairs_of_all_batches_are_made_once(spark, tmp_path):
    write(tmp_path, "orders", f"SELECT * FROM '{SF}/orders.parquet' WHERE o_custkey < 20")
    before = set(shared.written_so_far())
    assert same_as_sql(spark, "e10_incremental", tmp_path, "orders")
    assert sum("/dated-" in p for p in set(shared.written_so_far()) - before) == 1


def test_f8_f13_files_of_a_bucket_grow_in_number(spark, tmp_path, monkeypatch, request):
    """A change puts rows in place of others, takes some away, adds some; a bucket's files hold so many rows each."""
    monkeypatch.setattr("tracelake.store.ROWS_OF_A_FILE", 20)
    for key, value in (("spark.sql.shuffle.partitions", "64"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        old = spark.conf.get(key)
        spark.conf.set(key, value)
        request.addfinalizer(lambda key=key, old=old: spark.conf.set(key, old))
    st = store.Store(spark, str(tmp_path), {"t": store.Table("k long, v long", ("k",), ("k",))}, 2)
    rows = lambda low, high, v, gone: spark.range(low, high).selectExpr("id AS k", f"{v} AS v", f"{gone} AS gone")
    at = st.commit(st.snapshot(), {"t": rows(0, 400, "id", "CAST(NULL AS BOOLEAN)")})
    at = st.commit(at, {"t": rows(300, 500, "-id", "id % 4 = 0")})
    want = {k: k for k in range(300)} | {k: -k for k in range(300, 500) if k % 4}
    assert sorted(map(tuple, at.table("t").collect())) == sorted(want.items())
    assert max(len(list((tmp_path / f).glob("*.parquet"))) for f in at.folders["t"].values()) > store.SPREAD


def test_f9_links_walk_some_steps_a_round(spark, monkeypatch):
    """Two links walk up forty parents; the second comes to its own child over the first one."""
    kept = []
    monkeypatch.setattr(hierarchy, "written", lambda df, name: kept.append(name) or shared.written(df, name))
    parents = spark.createDataFrame([(k, k - 1 if k % 50 else None) for k in range(100)], "id long, parent long")
    links = spark.createDataFrame([(1, 50, 40), (2, 0, 90)], "idx long, child long, parent long")
    got = hierarchy.linked(parents, links).select("idx", "accepted")
    assert sorted(map(tuple, got.collect())) == [(1, True), (2, False)]
    assert kept.count("walks") < 30


def test_f10_edges_are_told_apart_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tracelake.plans.state.ROWS_OF_A_TASK", 100)
    for t in ("customer", "supplier", "orders", "nation"):
        write(tmp_path, t, f"SELECT * FROM '{SF}/{t}.parquet'")
    write(tmp_path, "lineitem", "SELECT CASE WHEN k % 7 > 0 THEN k % 30 END AS l_suppkey, CASE WHEN k % 11 > 0 THEN k % 100 END AS l_partkey FROM range(1000) t(k)")
    rows = same_as_sql(spark, "r6_real_edges", tmp_path, "customer", "supplier", "orders", "nation", "lineitem")
    assert len(rows) == 5
    plan = registry.QUERIES["r6_real_edges"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_f11_a_pair_is_a_row_whatever_its_suppliers(spark, tmp_path):
    write(tmp_path, "lineitem", "SELECT k // 3 AS l_orderkey, k % 40 AS l_partkey, CASE WHEN k % 5 > 0 THEN k * k % 60 END AS l_suppkey FROM range(900) t(k)")
    assert len(same_as_sql(spark, "r5_confirmed_hints", tmp_path, "lineitem")) == 2
    plan = registry.QUERIES["r5_confirmed_hints"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "l_suppkey" in line]


def test_f12_a_name_is_looked_up_once(spark, monkeypatch):
    asked, plain = [], identity.similar_names
    monkeypatch.setattr(identity, "similar_names", lambda left, *rest: asked.append(left.count()) or plain(left, *rest))
    rows = [(k, "a" if k % 2 else "b", "red bolt x") for k in range(40)] + [(90, "a", None), (91, None, "red bolt")]
    known = [(7, "a", "red bolt"), (5, "a", "red bolt"), (3, "b", "blue ring"), (1, None, "red bolt x")]
    got = identity.alike(spark.createDataFrame(rows, "id long, kind string, name string"), spark.createDataFrame(known, "id long, kind string, name string"))
    want = [(k, 5, "candidate") if k % 2 else (k, None, "new") for k in range(40)] + [(90, None, "new"), (91, None, "new")]
    assert sorted(map(tuple, got.select("id", "identity", "decision").collect())) == want
    assert asked == [4]


def test_f13_first_traces_are_written_once(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(clusters, "written", lambda df, name: kept.append(name) or shared.written(df, name))
    st = store.Store(spark, str(tmp_path), clusters.TRACE_TABLES, 4)
    nodes = spark.createDataFrame([(1, n, None if n == 0 else 0, n, "k", "x") for n in range(4)], clusters.TRACE_TABLES["trace"].schema)
    at = clusters.retraced(st, st.snapshot(), nodes)
    assert kept == []
    at = clusters.retraced(st, at, nodes.where("node < 2"))
    assert sorted(r["node"] for r in at.table("trace").collect()) == [0, 1] and kept == ["trace"]
