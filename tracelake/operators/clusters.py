"""Clusters that are kept from one detection to the next, traces, and cursors, in stores.

A detected blob that isn't known becomes a candidate; a candidate is parted into
groups, which become confirmed clusters and keep their identity when a later blob's
groups are much the same; a blob without groups is remembered by its signature, so
that it isn't judged again. Each step reads one version and makes the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators.graph import matched
from tracelake.operators.ingest import numbered
from tracelake.operators.latest import first_per_key
from tracelake.shared import written
from tracelake.store import Snapshot, Store, Table

CLUSTER_TABLES = {
    "clusters": Table("cluster_id long, status string, signature string, blob_signature string, members long, seen long", ("cluster_id",), ("cluster_id",)),
    "members": Table("cluster_id long, member long, pruned boolean", ("cluster_id", "member"), ("cluster_id",)),
}
TRACE_TABLES = {"trace": Table("inbox long, node long, parent long, seq long, kind string, label string", ("inbox", "node"), ("inbox",))}
CURSOR_TABLES = {"cursors": Table("source string, at long, batches long", ("source",), ("source",))}

LIVE = "status IN ('confirmed', 'stale')"


def signed(sets: DataFrame, key: str) -> DataFrame:
    """(key, members, signature) of (key, member) without repeats: the number of members
    and the sum of their hashes, alike for equal sets, and summed up before any shuffle."""
    part = F.conv(F.substring(F.md5(F.col("member").cast("string").cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    both = sets.groupBy(key).agg(F.count(F.lit(1)).alias("members"), F.sum(part).alias("_sum"))
    return both.select(key, "members", F.concat_ws("-", "members", "_sum").alias("signature"))


def _after(base: Snapshot) -> int:
    return base.table("clusters").agg(F.coalesce(F.max("cluster_id"), F.lit(-1))).first()[0] + 1


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    return numbered(rows.withColumn("_one", F.lit(0)), ["_one"], order).drop("_one")


def _change(rows: DataFrame, gone: bool = False, **columns: Column) -> DataFrame:
    return rows.withColumns(columns).withColumn("gone", F.lit(gone)).select(*CLUSTER_TABLES["clusters"].schema.names, "gone")


def _members(rows: DataFrame, gone: bool) -> DataFrame:
    return rows.select("cluster_id", "member", F.lit(False).alias("pruned"), F.lit(gone).alias("gone"))


def reconciled_blobs(store: Store, base: Snapshot, detected: DataFrame, run: int) -> Snapshot:
    """The store after a detection, (blob, member). A blob that has been parted, by its
    signature, is seen again; one that is a candidate or was rejected stays so; others
    become candidates. Candidates that aren't detected any more go with their members;
    confirmed clusters none of whose members, but pruned ones, is in any blob are dissolved."""
    found = written(detected.select("blob", "member").distinct(), "blobs")
    blobs = written(first_per_key(signed(found, "blob"), ["signature"], [F.col("blob")]), "signatures")
    here = blobs.select(F.col("signature").alias("_s"))
    stored = base.table("clusters")
    live = stored.where(LIVE)
    known = live.select(F.col("blob_signature").alias("signature")).unionByName(stored.where(F.col("status").isin("candidate", "rejected")).select("signature"))
    fresh = _placed(blobs.join(known, "signature", "left_anti"), ["signature"]).withColumn("cluster_id", F.col("place") + _after(base))
    fresh = written(fresh.select("cluster_id", "blob", "signature", "members"), "candidates")

    again = live.join(here.withColumnRenamed("_s", "blob_signature"), "blob_signature", "left_semi").select("cluster_id", F.lit(True).alias("_again"))
    lost = stored.where("status = 'candidate'").join(here.withColumnRenamed("_s", "signature"), "signature", "left_anti")
    met = base.table("members").where("NOT pruned").join(found.select("member").distinct(), "member", "left_semi").select("cluster_id").distinct()
    ended = live.join(met, "cluster_id", "left_anti").select("cluster_id", F.lit(True).alias("_ended"))
    kept = live.join(again, "cluster_id", "left").join(ended, "cluster_id", "left").where("_again OR _ended")
    clusters = _change(kept, status=F.when(F.col("_ended"), "dissolved").otherwise(F.col("status")), seen=F.when(F.col("_again"), F.lit(run)).otherwise(F.col("seen")).cast("long"))
    clusters = clusters.unionByName(_change(lost, True)).unionByName(_change(fresh, status=F.lit("candidate"), blob_signature=F.col("signature"), seen=F.lit(run).cast("long")))
    members = _members(fresh.select("cluster_id", "blob").join(found, "blob"), False)
    members = members.unionByName(_members(base.table("members", lost).join(lost.select("cluster_id"), "cluster_id", "left_semi"), True))
    return store.commit(base, {"clusters": clusters, "members": members})


def parted(store: Store, base: Snapshot, candidates: DataFrame, groups: DataFrame, run: int, least: float = 0.5) -> Snapshot:
    """The store after candidates (cluster_id) were parted into groups (cluster_id, grp,
    member). A group whose Jaccard similarity to a confirmed cluster that meets the
    blob is at least `least`, the most similar first and one to one, becomes its new
    members: it keeps its id, and members that stay keep being pruned. Other groups are
    new clusters; confirmed ones that meet the blob and match no group are dissolved.
    The candidate goes; one without groups is remembered as rejected, once a signature."""
    stored = base.table("clusters")
    chosen = written(stored.where("status = 'candidate'").join(candidates.select("cluster_id").distinct(), "cluster_id", "left_semi"), "chosen")
    inside = written(base.table("members", chosen).join(chosen.select("cluster_id"), "cluster_id", "left_semi").select("cluster_id", "member"), "blob-members")
    sets = written(groups.select("cluster_id", "grp", "member").distinct().join(chosen.select("cluster_id", F.col("signature").alias("blob_signature")), "cluster_id"), "groups")
    ids = written(_placed(sets.select("cluster_id", "grp", "blob_signature").distinct(), ["cluster_id", "grp"]).withColumnRenamed("place", "gid"), "group-ids")
    of_group = written(sets.join(ids.select("cluster_id", "grp", "gid"), ["cluster_id", "grp"]).select("gid", "member"), "group-members")

    held = base.table("members").join(stored.where(LIVE).select("cluster_id"), "cluster_id", "left_semi")
    old = held.where("NOT pruned").join(inside.select("member").distinct(), "member", "left_semi").select("cluster_id").distinct()
    old_members = written(held.join(old, "cluster_id", "left_semi"), "old-members")
    pairs = matched(of_group.select(F.col("gid").alias("group"), F.col("member").alias("id")), old_members.select(F.col("cluster_id").alias("child"), F.col("member").alias("id")), least)
    pairs = written(pairs.select(F.col("group").alias("gid"), F.col("child").alias("cluster_id")), "matched")

    fresh = _placed(ids.join(pairs, "gid", "left_anti").select("gid"), ["gid"]).select("gid", (F.col("place") + _after(base)).alias("cluster_id"))
    target = written(pairs.select("gid", "cluster_id", F.lit(False).alias("new")).unionByName(fresh.withColumn("new", F.lit(True))), "targets")
    rows = target.join(signed(of_group, "gid"), "gid").join(ids.select("gid", "blob_signature"), "gid")
    clusters = _change(rows, status=F.lit("confirmed"), seen=F.lit(run).cast("long"))
    ended = old_members.select("cluster_id").distinct().join(pairs.select("cluster_id"), "cluster_id", "left_anti")
    clusters = clusters.unionByName(_change(stored.join(ended, "cluster_id", "left_semi"), status=F.lit("dissolved")))

    noise = chosen.join(sets.select("cluster_id").distinct(), "cluster_id", "left_anti")
    memo = first_per_key(noise, ["signature"], [F.col("cluster_id")]).join(stored.where("status = 'rejected'").select("signature"), "signature", "left_anti").select("cluster_id", F.lit(True).alias("_memo"))
    done = written(chosen.join(memo, "cluster_id", "left"), "consumed")
    clusters = clusters.unionByName(_change(done.where("_memo"), status=F.lit("rejected"))).unionByName(_change(done.where("_memo IS NULL"), True))

    now = target.join(of_group, "gid").select("cluster_id", "member")
    before = old_members.join(pairs.select("cluster_id"), "cluster_id", "left_semi").select("cluster_id", "member")
    keys = ["cluster_id", "member"]
    members = _members(now.join(before, keys, "left_anti"), False).unionByName(_members(before.join(now, keys, "left_anti"), True))
    members = members.unionByName(_members(inside.join(done.where("_memo IS NULL"), "cluster_id", "left_semi"), True))
    return store.commit(base, {"clusters": clusters, "members": members})


def retraced(store: Store, base: Snapshot, nodes: DataFrame) -> Snapshot:
    """The store with the traces of some inboxes written anew: (inbox, node, parent, seq,
    kind, label); nodes that these inboxes had before and have no more go."""
    nodes = nodes.select(*TRACE_TABLES["trace"].schema.names)
    if not base.folders.get("trace"):  # nothing was there that could go
        return store.commit(base, {"trace": nodes.withColumn("gone", F.lit(False))})
    new = written(nodes, "trace")
    had = base.table("trace", new).join(new.select("inbox").distinct(), "inbox", "left_semi").join(new, ["inbox", "node"], "left_anti")
    return store.commit(base, {"trace": new.withColumn("gone", F.lit(False)).unionByName(had.withColumn("gone", F.lit(True)))})


def attached(store: Store, base: Snapshot, leaves: DataFrame) -> Snapshot:
    """The store with (inbox, parent, kind, label) as further children, behind those that
    the parent has, in order of kind and label. Leaves of nodes that aren't there are left out."""
    leaves = written(leaves, "leaves")
    had = written(base.table("trace", leaves).join(leaves.select("inbox").distinct(), "inbox", "left_semi"), "traces")
    under = leaves.join(had.select("inbox", F.col("node").alias("parent")), ["inbox", "parent"], "left_semi")
    last = had.groupBy("inbox").agg(F.max("node").alias("_node"))
    kids = had.where("parent IS NOT NULL").groupBy("inbox", "parent").agg((F.max("seq") + 1).alias("_seq"))
    order = ["parent", "kind", "label"]
    rows = numbered(numbered(under, ["inbox"], order).withColumnRenamed("place", "_n"), ["inbox", "parent"], order[1:])
    rows = rows.join(last, "inbox").join(kids, ["inbox", "parent"], "left")
    rows = rows.select("inbox", (F.col("_node") + 1 + F.col("_n")).alias("node"), "parent", (F.coalesce("_seq", F.lit(0)) + F.col("place")).alias("seq"), "kind", "label", F.lit(False).alias("gone"))
    return store.commit(base, {"trace": rows})


def moved_cursors(store: Store, base: Snapshot, cursors: DataFrame) -> Snapshot:
    """The store with sources' cursors (source, at) put forward; none goes back."""
    new = written(cursors.groupBy("source").agg(F.max("at").alias("at")), "cursors")
    had = base.table("cursors", new).select("source", F.col("at").alias("_at"), F.col("batches").alias("_n"))
    rows = new.join(had, "source", "left").where("_at IS NULL OR at > _at")
    return store.commit(base, {"cursors": rows.select("source", "at", (F.coalesce("_n", F.lit(0)) + 1).cast("long").alias("batches"), F.lit(False).alias("gone"))})
