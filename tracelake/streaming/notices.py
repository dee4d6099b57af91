"""A queue of notices as a stream's state: one notice a user and key.

What is emitted again refreshes a notice's content and expiry, but it keeps when it
was made, read and dismissed. A notice ends at its expiry, so the state holds what
is still due, not all there ever was; a notice emitted after that is a new one.

The state is a table in the checkpoint's folder, one for each batch, made of the one
before and the batch's actions in one shuffle: a batch costs as much as its rows and
what is due, and no Python runs for a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.shared import removed

KEY = ("user_id", "dedup_key")
_STATE = "user_id long, dedup_key string, created long, read long, dismissed long, expires long, content string, emitted long"
ROW = f"{_STATE}, purged boolean"


def queued(actions: DataFrame, due: DataFrame, passed: int | None) -> DataFrame:
    """Notices after a batch's actions, as their columns in `ROW` and whether an action or a later
    notice touched them: from (user_id, dedup_key, seq, at, op: emit, read or dismiss, content, expires_at),
    at and expires_at timestamps, and what was due before. Times are microseconds. What isn't there
    can't be read or dismissed; what is emitted without content keeps the content before."""
    none = lambda kind, *names: {n: F.lit(None).cast(kind) for n in names}
    new = actions.select(*KEY, "seq", F.unix_micros("at").alias("at"), "op", "content", F.unix_micros("expires_at").alias("expires"))
    new = (new if passed is None else new.where(F.col("at") > passed)).withColumns({"held": F.lit(False), **none("long", "created", "read", "dismissed", "emitted")})
    old = due.withColumns({"held": F.lit(True), "op": F.lit("emit"), **none("long", "at", "seq")})
    # what was due comes first, then the actions by time and number
    turn = Window.partitionBy(*KEY).orderBy(F.desc("held"), "at", "seq")
    emit, of = F.col("op") == "emit", lambda op: F.min(F.when(F.col("alive") & (F.col("op") == op), F.col("at")))
    rows = old.unionByName(new).withColumn("last", F.last(F.when(emit, F.col("expires")), True).over(turn.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("alive", F.coalesce(F.col("last") > F.col("at"), F.lit(False)))
    rows = rows.withColumn("first", emit & ~F.col("alive")).withColumn("life", F.sum(F.col("first").cast("long")).over(turn.rowsBetween(Window.unboundedPreceding, 0)))
    order = F.struct(~F.col("held"), "at", "seq")
    lives = rows.where("life > 0").groupBy(*KEY, "life").agg(
        F.max(F.when(F.col("first"), F.coalesce("created", "at"))).alias("created"), F.coalesce(F.max("read"), of("read")).alias("read"), F.coalesce(F.max("dismissed"), of("dismiss")).alias("dismissed"),
        F.max_by("expires", F.when(emit, order)).alias("expires"), F.max_by("content", F.when(emit & F.col("content").isNotNull(), order)).alias("content"),
        F.sum(F.when(emit, F.coalesce("emitted", F.lit(1)))).cast("long").alias("emitted"),
        F.bool_or(~emit & ~F.col("alive")).alias("over"), F.bool_or(~F.col("held")).alias("touched"),
    )
    later = F.col("life") < F.max("life").over(Window.partitionBy(*KEY))
    return lives.withColumns({"purged": F.col("over") | later, "touched": F.col("touched") | later}).drop("life", "over")


def kept_queue(actions: DataFrame, late: str, target: str, checkpoint: str):
    """Starts the queue; a batch's changes go to a folder of its number, which a batch that is run again
    writes anew, from what was due before it. Actions that are `late` behind the last one of earlier
    batches are left out; notices whose expiry lies as far behind the last one are purged."""
    due = f"{checkpoint}/due"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        passed, before = None, spark.createDataFrame([], _STATE)
        if number:
            passed = spark.read.parquet(f"{due}/{number - 1}/passed").first()["passed"]
            before = spark.read.schema(ROW).parquet(f"{due}/{number - 1}/notices").where("NOT purged").drop("purged")
        now = batch.agg(F.greatest(F.lit(passed).cast("long"), F.unix_micros(F.max("at") - F.expr(f"INTERVAL {late}"))).alias("passed"))
        now.write.mode("overwrite").parquet(f"{due}/{number}/passed")
        now = spark.read.parquet(f"{due}/{number}/passed").first()["passed"]
        got = queued(batch, before, passed).withColumn("purged", F.col("purged") | F.coalesce(F.col("expires") <= F.lit(now).cast("long"), F.lit(False)))
        got.write.mode("overwrite").parquet(f"{due}/{number}/notices")
        got = spark.read.schema(got.schema).parquet(f"{due}/{number}/notices")
        got.where("touched OR purged").drop("touched").write.mode("overwrite").parquet(f"{target}/batch={number}")
        if number > 1:
            removed(spark, f"{due}/{number - 2}")  # a batch that is run again reads the one before it

    return actions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def notices(changes: DataFrame) -> DataFrame:
    """The last state of each notice from its changes, which have the batch's number."""
    last = F.max_by(F.struct("read", "dismissed", "expires", "content", "emitted", "purged"), F.struct("batch", "purged", "emitted"))
    return changes.groupBy("user_id", "dedup_key", "created").agg(last.alias("x")).select("user_id", "dedup_key", "created", "x.*")
