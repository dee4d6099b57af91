"""Stores of versions and what is kept in them; streams that keep state, follow rules or poll."""

import datetime
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelake.operators import calendar_sync, clusters, consolidate, senders
from tracelake.operators.rules import MailRule, Rule, mail_matches
from tracelake.sources import polling
from tracelake.store import Conflict, Store, Table
from tracelake.streaming import live, notices

ROWS = {"rows": Table("id long, name string", ("id",), ("id",))}


def changes(spark, *rows):
    return {"rows": spark.createDataFrame(rows, "id long, name string, gone boolean")}


def held(df):
    return sorted(map(tuple, df.collect()))


def test_versions_of_a_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", ROWS, 4)
    empty = store.snapshot()
    first = store.commit(empty, changes(spark, (1, "a", False), (2, "b", None), (3, "c", False)))
    second = store.commit(first, changes(spark, (2, "B", False), (3, None, True), (9, None, True)))
    assert (empty.version, held(empty.table("rows"))) == (0, []) and store.versions() == [1, 2]
    assert held(first.table("rows")) == [(1, "a"), (2, "b"), (3, "c")] and held(second.table("rows")) == [(1, "a"), (2, "B")]
    assert held(store.snapshot(1).table("rows")) == held(first.table("rows"))  # a reader keeps to its version
    with pytest.raises(Conflict):
        store.commit(first, changes(spark, (7, "late", False)))
    assert held(store.snapshot().table("rows")) == [(1, "a"), (2, "B")]
    third = store.commit(second, changes(spark, (4, "d", False)))
    shared = set(second.folders["rows"].values()) & set(third.folders["rows"].values())
    assert shared  # buckets that a change doesn't touch aren't written again
    store.expire(1)
    assert store.versions() == [3] and held(store.snapshot().table("rows")) == [(1, "a"), (2, "B"), (4, "d")]


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", ROWS, 4)
    first = store.commit(store.snapshot(), changes(spark, (1, "a", False)))
    broken = spark.range(2).select("id", F.raise_error(F.lit("lost")).cast("string").alias("name"), F.lit(False).alias("gone"))
    with pytest.raises(Exception, match="lost"):
        store.commit(first, {"rows": broken})
    (tmp_path / "s/versions/000000000002.json").touch()  # a writer that was lost after it had claimed the number
    assert store.versions() == [1] and held(store.snapshot().table("rows")) == [(1, "a")]


def test_only_touched_buckets_are_read(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", ROWS, 16)
    base = store.commit(store.snapshot(), {"rows": spark.range(500).select("id", F.lit("x").alias("name"), F.lit(False).alias("gone"))})
    some = base.table("rows", spark.range(1))
    assert len(some.inputFiles()) < len(base.table("rows").inputFiles()) / 8 and some.where("id = 0").count() == 1


def test_groups_after_batches_are_those_of_all_pairs(spark, tmp_path):
    rng = random.Random(3)
    store, known, pairs = Store(spark, f"file://{tmp_path}/g", consolidate.GROUP_TABLES, 8), [], []
    at = store.snapshot()
    for batch in range(3):
        new = list(range(100 * batch, 100 * batch + 40))
        known += new
        more = [(rng.choice(known), rng.choice(new)) for _ in range(18)]
        pairs += more
        at, _ = consolidate.extended(store, at, spark.createDataFrame([(i,) for i in new], "id long"), spark.createDataFrame(more, "a_id long, b_id long"))
        root = {i: i for i in known}

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        want = sorted((i, find(i)) for i in known)
        assert held(at.table("by_id")) == want and held(at.table("by_root").select("id", "root")) == want


def test_a_pair_that_joins_two_old_groups_moves_one_of_them(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/g", consolidate.GROUP_TABLES, 64)
    ids = spark.range(1, 2000)
    at, _ = consolidate.extended(store, store.snapshot(), ids, spark.createDataFrame([(k, k + 1) for k in range(10, 15)] + [(k, k + 1) for k in range(30, 33)], "a_id long, b_id long"))
    after, changed = consolidate.extended(store, at, spark.createDataFrame([(5000,)], "id long"), spark.createDataFrame([(15, 5000), (5000, 33)], "a_id long, b_id long"))
    assert held(changed) == [(30, 10), (31, 10), (32, 10), (33, 10), (5000, 10)]
    same = set(at.folders["by_id"].values()) & set(after.folders["by_id"].values())
    assert len(same) > 50  # most buckets are the old version's


def test_blobs_from_new_to_dissolved(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/c", clusters.CLUSTER_TABLES, 2)
    found = lambda **blobs: spark.createDataFrame([(k, m) for k, (_, ms) in enumerate(blobs.items()) for m in ms], "blob long, member long")
    state = lambda s: {(r["status"], r["members"], r["seen"]) for r in s.table("clusters").collect()}
    at = clusters.reconciled_blobs(store, store.snapshot(), found(a=[1, 2, 3, 4], b=[5, 6], c=[7, 8, 9]), 0)
    assert state(at) == {("candidate", 4, 0), ("candidate", 2, 0), ("candidate", 3, 0)}
    same = clusters.reconciled_blobs(store, at, found(a=[1, 2, 3, 4], b=[5, 6], c=[7, 8, 9]), 1)
    assert state(same) == state(at)  # candidates stay, none twice
    ids = {r["members"]: r["cluster_id"] for r in same.table("clusters").collect()}
    groups = spark.createDataFrame([(ids[4], 0, 1), (ids[4], 0, 2), (ids[4], 1, 3), (ids[4], 1, 4)], "cluster_id long, grp long, member long")
    parted = clusters.parted(store, same, spark.createDataFrame([(ids[4],), (ids[2],)], "cluster_id long"), groups, 1)
    assert state(parted) == {("confirmed", 2, 1), ("rejected", 2, 0), ("candidate", 3, 0)}
    # the parted blob is seen again, the rejected one stays, the waiting candidate isn't there any more
    again = clusters.reconciled_blobs(store, parted, found(a=[1, 2, 3, 4], b=[5, 6]), 2)
    assert state(again) == {("confirmed", 2, 2), ("rejected", 2, 0)}
    one = next(r["cluster_id"] for r in again.table("members").where("member = 1").collect())
    marked = store.commit(again, {"members": spark.createDataFrame([(one, 1, True, False)], "cluster_id long, member long, pruned boolean, gone boolean")})
    # the blob grows: its groups are the old clusters with another member, under the same ids; pruned members stay pruned
    grown = clusters.reconciled_blobs(store, marked, found(a=[1, 2, 3, 4, 10], d=[20, 21]), 3)
    blob = next(r["cluster_id"] for r in grown.table("clusters").where("status = 'candidate' AND members = 5").collect())
    groups = spark.createDataFrame([(blob, 0, 1), (blob, 0, 2), (blob, 0, 10), (blob, 1, 77)], "cluster_id long, grp long, member long")
    last = clusters.parted(store, grown, spark.createDataFrame([(blob,)], "cluster_id long"), groups, 3)
    assert held(last.table("members").where(F.col("cluster_id") == one).select("member", "pruned")) == [(1, True), (2, False), (10, False)]
    assert sorted(r["status"] for r in last.table("clusters").collect()) == ["candidate", "confirmed", "confirmed", "dissolved", "rejected"]
    gone = clusters.reconciled_blobs(store, last, found(d=[1, 20]), 4)  # 1 is pruned, so nothing holds its cluster
    assert sorted(r["status"] for r in gone.table("clusters").collect()) == ["candidate", "dissolved", "dissolved", "dissolved", "rejected"]


def test_traces_are_written_anew_and_get_leaves(spark, tmp_path):
    store, ddl = Store(spark, f"file://{tmp_path}/t", clusters.TRACE_TABLES, 2), clusters.TRACE_TABLES["trace"].ddl
    at = clusters.retraced(store, store.snapshot(), spark.createDataFrame([(1, 0, None, 0, "root", "a"), (1, 1, 0, 0, "x", "b"), (1, 2, 0, 1, "x", "c"), (2, 0, None, 0, "root", "d")], ddl))
    at = clusters.retraced(store, at, spark.createDataFrame([(1, 0, None, 0, "root", "again"), (1, 1, 0, 0, "x", "z")], ddl))
    at = clusters.attached(store, at, spark.createDataFrame([(1, 0, "leaf", "q"), (1, 0, "leaf", "p"), (2, 0, "leaf", "r"), (2, 9, "leaf", "s"), (3, 0, "leaf", "t")], "inbox long, parent long, kind string, label string"))
    assert sorted(map(tuple, at.table("trace").where("node > 0 OR inbox = 1").collect())) == [(1, 0, None, 0, "root", "again"), (1, 1, 0, 0, "x", "z"), (1, 2, 0, 1, "leaf", "p"), (1, 3, 0, 2, "leaf", "q"), (2, 1, 0, 0, "leaf", "r")]


def second(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=n)


def test_a_notice_emitted_again_stays_read(spark, tmp_path):
    ddl = "user_id long, dedup_key string, seq long, at timestamp, op string, content string, expires_at timestamp"
    parts = [
        [(1, "k", 0, second(0), "emit", "one", second(100)), (1, "k", 1, second(10), "read", None, None), (2, "k", 2, second(0), "emit", "short", second(50))],
        [(1, "k", 3, second(60), "emit", "two", second(200)), (1, "k", 4, second(70), "read", None, None), (1, "k", 5, second(80), "dismiss", None, None), (2, "k", 6, second(90), "read", None, None)],
        [(2, "k", 7, second(95), "emit", "later", second(300)), (3, "k", 8, second(150), "read", None, None), (9, "z", 9, second(260), "emit", "now", second(900))],
    ]
    folder, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for part in parts:
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(folder)
        notices.kept_queue(live.stream(spark, folder, 1), "1 second", target, f"file://{tmp_path}/state").awaitTermination()  # restarted each time
    epoch = int(datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC).timestamp())
    at = lambda us: None if us is None else us // 1_000_000 - epoch
    got = {(r["user_id"], at(r["created"])): (at(r["read"]), at(r["dismissed"]), at(r["expires"]), r["content"], r["emitted"], r["purged"]) for r in notices.notices(spark.read.parquet(target)).collect()}
    assert got == {
        (1, 0): (10, 80, 200, "two", 2, True), (2, 0): (None, None, 50, "short", 1, True), (2, 95): (None, None, 300, "later", 1, False), (9, 260): (None, None, 900, "now", 1, False),
    }
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_rules_hold_from_the_next_batch_and_a_batch_run_again_decides_alike(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/rules", live.RULE_TABLES, 2)
    put = lambda *rules: store.commit(store.snapshot(), {"rules": spark.createDataFrame([(r.id, r.action, json.dumps(r.scope), r.priority, r.enabled, False) for r in rules], live.RULE_TABLES["rules"].ddl + ", gone boolean")})
    rows = lambda low: spark.range(low, low + 10).selectExpr("id", "concat('{\"k\": ', id % 10, '}') AS payload").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: live.ruled(live.stream(spark, f"{tmp_path}/in"), store, f"{tmp_path}/out", f"{tmp_path}/state", trigger={"availableNow": True}).awaitTermination()
    kept = lambda: sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out/kept").collect())
    put(Rule(1, "ignore", {"k": {"in": [1, 2]}}))
    rows(0)
    run()
    put(Rule(1, "ignore", {"k": {"equals": 5}}))
    rows(10)
    run()
    want = [0, *range(3, 10), *range(10, 15), *range(16, 20)]
    assert kept() == want
    (tmp_path / "state/commits/1").unlink()  # the second batch wasn't known to be done
    (tmp_path / "state/commits/.1.crc").unlink(missing_ok=True)
    put(Rule(1, "ignore", {}))
    run()
    assert kept() == want


def events(spark, path, ids):
    spark.createDataFrame([(i, i % 5, float(i)) for i in ids], "event_id long, user_id long, value double").coalesce(1).write.mode("append").parquet(path)


def test_a_polled_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    polling.registered(spark)
    events(spark, f"{tmp_path}/in", range(50))
    cursor = tmp_path / "cursor/at.json"
    options = {"path": f"{tmp_path}/in", "id": "event_id", "account": "user_id", "shards": 3, "limit": 20, "cursor": str(cursor)}

    def start(fails=None):
        rows = spark.readStream.format("polled").options(**options).load()

        def write(batch, number):
            batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
            if number == fails:
                raise InterruptedError("the sink has it, the source doesn't know")

        query = rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/state").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    with pytest.raises(Exception, match="the source doesn't know"):
        start(fails=1)
    assert json.loads(cursor.read_text())["at"] == 19  # of the batch that is done, not of the one that failed
    start()
    events(spark, f"{tmp_path}/in", range(50, 60))
    start()
    got = spark.read.parquet(f"{tmp_path}/out").toPandas()
    assert sorted(got["event_id"]) == list(range(60)) and got.groupby("batch").size().to_dict() == {0: 20, 1: 20, 2: 10, 3: 10}


def test_conditions_reach_the_reader(spark, tmp_path):
    events(spark, f"{tmp_path}/in", range(40))
    reader = polling.PolledReader({"path": f"{tmp_path}/in", "id": "event_id", "account": "user_id"}, spark.read.parquet(f"{tmp_path}/in").schema)
    rest = list(reader.pushFilters([polling.GreaterThan(("event_id",), 10), polling.EqualTo(("user_id",), 2), polling.LessThan(("value",), 30.0)]))
    assert rest == [polling.LessThan(("value",), 30.0)] and len(reader.partitions()) == 1
    got = pd.concat(b.to_pandas() for p in reader.partitions() for b in reader.read(p))
    assert sorted(got["event_id"]) == [12, 17, 22, 27, 32, 37]
    polling.registered(spark)
    rows = spark.read.format("polled").options(path=f"{tmp_path}/in", id="event_id", account="user_id").load()
    assert sorted(r["event_id"] for r in rows.where("event_id > 10 AND user_id = 2 AND value < 30").collect()) == [12, 17, 22, 27]


MESSAGES = "message long, medium string, sender string, account string, name string, bot boolean, platform string, email string"


def test_senders_by_medium(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/d", senders.DIRECTORY_TABLES, 2)
    at = store.commit(store.snapshot(), {
        "identities": spark.createDataFrame([(1, "person", "Ann", False), (2, "company", "Acme S.A.", False), (3, "person", "Bob", False)], "id long, kind string, name string, gone boolean"),
        "identifiers": spark.createDataFrame([("email", "email", "ann@acme.com", 1, False), ("domain", "domain", "known.com", 2, False), ("chat", "handle", "bob", 3, False)], "platform string, kind string, value string, id long, gone boolean"),
    })
    mail = lambda n, address, name=None: (n, "email", None, None, name, None, None, address)
    rows = [
        mail(1, "Ann+x@acme.com"), mail(2, "other@acme.com", "Other"), mail(3, "someone@gmail.com"), mail(4, "noreply@mail.known.com"), mail(5, "noreply@new.com"), mail(6, "no-reply@x.new.com", " ACME Inc "), mail(7, "mailer@new.com"),
        mail(8, "mailer@fresh.com", "Fresh"), mail(9, "nothing"), mail(10, None), mail(11, "noreply@gmail.com", "Gmail"),
        (20, "chat", "77", "@Bob", "Robert", False, None, None), (21, "chat", "88", None, None, False, None, None), (22, "chat", "99", "@cy", "Cy", True, None, None), (23, "chat", "55", "@dee", "Dee", None, None, None), (24, "chat", "66", "@Dee", "D2", None, None, None),
        (30, "social", None, "@Shop", None, None, " Insta ", None), (31, "social", None, "shop", None, None, "insta", None), (32, "social", None, "shop", None, None, "x", None), (33, "social", None, "@", None, None, "x", None),
    ]
    at, found = senders.resolved_senders(store, at, spark.createDataFrame(rows, MESSAGES))
    names = {r["id"]: r["name"] for r in at.table("identities").collect()}
    got = {r["message"]: (r["kind"], names[r["id"]]) for r in found.collect()}
    assert got == {
        1: ("person", "Ann"), 4: ("company", "Acme S.A."), 6: ("company", "Acme S.A."), 7: ("company", "Acme S.A."), 8: ("company", "Fresh"), 20: ("person", "Bob"), 21: ("person", "chat 88"), 23: ("person", "Dee"), 24: ("person", "Dee"),
        30: ("unknown", "@Shop"), 31: ("unknown", "@Shop"), 32: ("unknown", "shop"),
    }
    again, found = senders.resolved_senders(store, at, spark.createDataFrame([mail(40, "noreply@new.com"), (41, "chat", "66", None, None, None, None, None), (42, "social", None, "SHOP", None, None, "x", None)], MESSAGES))
    assert {r["message"]: names[r["id"]] for r in found.collect()} == {40: "Acme S.A.", 41: "Dee", 42: "shop"} and again.table("identities").count() == len(names)


def test_calendar_changes_are_logged(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/c", calendar_sync.TABLES, 2)
    ddl = "account long, event string, deleted boolean, seq long, title string, etag string, echo_of long"
    rows = lambda *r: spark.createDataFrame(r, ddl).withColumns({"starts_on": F.lit(None).cast("date"), "ends_on": F.lit(None).cast("date"), "status": F.lit("confirmed")})
    at = calendar_sync.synced(store, store.snapshot(), rows((1, "a", None, 0, "A", "1", None), (1, "b", False, 0, "B", None, 5), (1, "b", False, 1, "B2", None, 5), (1, "z", True, 0, "Z", "1", None)), 0)
    at = calendar_sync.synced(store, at, rows((1, "a", False, 0, "other", "1", None), (1, "b", False, 0, "B3", None, 5), (2, "a", False, 0, "A of 2", "1", None)), 1)
    at = calendar_sync.synced(store, at, rows((1, "a", True, 0, None, None, None)), 2)
    assert sorted((r["id"], r["title"], r["status"], r["manual"], r["priority_rank"]) for r in at.table("entries").collect()) == [(0, "A", "cancelled", True, 100), (1, "B3", "confirmed", False, 0), (2, "A of 2", "confirmed", True, 100)]
    assert sorted((r["run"], r["id"], r["action"]) for r in at.table("changes").collect()) == [(0, 0, "created"), (0, 1, "created"), (1, 1, "modified"), (1, 2, "created"), (2, 0, "deleted")]


def test_mail_rules_hold_by_all_their_predicates(spark):
    mail = spark.createDataFrame([("A@X.com", "News", "Big Sale today", "hello"), ("b@y.com", None, None, "a sale here"), (None, None, None, None)], "email string, list_id string, subject string, body string")
    columns = {c: F.col(c) for c in mail.columns}
    held = lambda rule: [r[0] for r in mail.select(mail_matches(rule, **columns)).collect()]
    assert held(MailRule(1, "block", "sender_email", " a@x.COM ")) == [True, False, False]
    assert held(MailRule(1, "block", "sender_domain", "y.com")) == [False, True, False] and held(MailRule(1, "block", "list_id", "news")) == [True, False, False]
    assert held(MailRule(1, "block", pattern="sale", field="subject_or_body")) == [True, True, False]
    assert held(MailRule(1, "block", "sender_domain", "x.com", "hello", "subject")) == [False] * 3
    assert held(MailRule(1, "block")) == held(MailRule(1, "block", "list_id", "  ")) == held(MailRule(1, "block", pattern="(a+)+", field="body")) == held(MailRule(1, "block", pattern="a", field="date")) == [False] * 3
    with pytest.raises(ValueError, match="no such kind"):
        held(MailRule(1, "block", "phone", "1"))


def test_owners_of_a_domain(spark):
    mails = spark.createDataFrame([(1, "acme.com"), (2, "acme.com"), (3, "other.org"), (4, "")], "message long, domain string")
    mentions = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 99), (4, 11)], "message long, id long")
    companies = spark.createDataFrame([(10, "Faculty", 20), (11, "Shop", None), (12, "Acme", None), (20, "University", 21), (21, "State", 777), (30, "Elsewhere", None)], "id long, name string, parent long")
    got = sorted(map(tuple, senders.domain_owners(mails, mentions, companies).collect()))
    assert got == [("acme.com", 10, "met"), ("acme.com", 11, "met"), ("acme.com", 12, "alike"), ("acme.com", 20, "above"), ("acme.com", 21, "above")]
    assert sorted(r["id"] for r in senders.domain_owners(mails, mentions, companies, most=1).collect()) == [10, 20, 21]
