"""Calendar entries of providers, kept in a store with a log of what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.ingest import numbered
from tracelake.operators.latest import first_per_key
from tracelake.shared import written
from tracelake.store import Snapshot, Store, Table

#: Rank of entries that a person made at the provider, not this system (fixed value).
MANUAL_RANK = 100

CONTENT = "title string, starts_on date, ends_on date, status string, etag string, echo_of long"
TABLES = {
    "entries": Table(f"account long, event string, id long, {CONTENT}, manual boolean, priority_rank int", ("account", "event"), ("account", "event")),
    "changes": Table("run long, id long, account long, event string, action string", ("run", "id"), ("id",)),
}


def synced(store: Store, base: Snapshot, events: DataFrame, run: int) -> Snapshot:
    """The store after a provider's answer: (account, event, deleted, seq, content). Of an
    event's several states the last by seq counts. New ones get the next ids, by account
    and event, and are manual unless they echo an entry of ours; a state whose etag is
    the stored one changes nothing; a deleted event that is stored is marked as
    cancelled and stays, one that isn't stored leaves no trace. Each change is logged."""
    keys = ["account", "event"]
    rows = written(first_per_key(events, keys, [F.desc("seq")]), "provider")
    stored = base.table("entries", rows).select(*keys, F.col("id"), F.col("etag").alias("_etag"))
    rows = rows.withColumn("deleted", F.coalesce("deleted", F.lit(False))).join(stored, keys, "left")
    same = F.coalesce(F.col("etag") == F.col("_etag"), F.lit(False))
    action = F.when(F.col("deleted"), F.when(F.col("id").isNotNull(), "deleted")).when(F.col("id").isNull(), "created").when(~same, "modified")
    rows = written(rows.withColumn("action", action).where("action IS NOT NULL"), "actions")
    after = base.table("entries").agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0] + 1
    new = numbered(rows.where("action = 'created'").withColumn("_one", F.lit(0)), ["_one"], keys).select(*keys, (F.col("place") + after).alias("_id"))
    manual = F.col("echo_of").isNull()
    rows = written(rows.join(new, keys, "left").withColumns({"id": F.coalesce("id", "_id"), "manual": manual, "priority_rank": F.when(manual, MANUAL_RANK).otherwise(0)}), "synced")
    names = TABLES["entries"].schema.names
    gone = rows.where("action = 'deleted'").select(*keys)
    cancelled = base.table("entries", gone).join(gone, keys, "left_semi").withColumn("status", F.lit("cancelled"))
    entries = rows.where("action <> 'deleted'").select(*names).unionByName(cancelled.select(*names)).withColumn("gone", F.lit(False))
    log = rows.select(F.lit(run).cast("long").alias("run"), "id", *keys, "action", F.lit(False).alias("gone"))
    return store.commit(base, {"entries": entries, "changes": log})
