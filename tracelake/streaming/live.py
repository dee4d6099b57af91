"""Structured Streaming: idempotent ingestion, windows with watermarks, retries."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import rules
from tracelake.shared import new_path
from tracelake.store import Snapshot, Store, Table

#: Rules as a store has them: a rule's conditions as JSON.
RULE_TABLES = {"rules": Table("id long, action string, scope string, priority int, enabled boolean", ("id",), ("id",))}


@contextmanager
def on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, on disk, not in the executors' memory."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stream(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """A file or folder of Parquet as a stream, so many files to a trigger."""
    pattern = f"{path[:-1]}[{path[-1]}]"  # matches the path alone; as a pattern it may be a file, too
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(pattern)


def ingested(rows: DataFrame, target: str, keys: list[str], checkpoint: str, filters: list[rules.Rule] | None = None, payload: str = "payload"):
    """Writes what a stream brings and brought not before, one row of each key,
    after the rules. The keys seen are the stream's state, so a batch costs as
    much as its rows, however many came before. A batch that is run again writes
    to the folder of its number once more, so a lost executor or driver leaves no
    row twice."""
    kept = rows if not filters else rules.filtered(rows, filters, payload=payload)[0]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    new = kept.dropDuplicates(keys)
    with on_disk(rows.sparkSession):
        return new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(rows: DataFrame, target: str, checkpoint: str):
    """Starts a stream that writes each batch to the folder of its number, once more if the batch is run again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def listed(at: Snapshot) -> list[rules.Rule]:
    """The rules of a version; they are few, since each is a part of every plan."""
    return [rules.Rule(r["id"], r["action"], json.loads(r["scope"]), r["priority"], r["enabled"]) for r in at.table("rules").orderBy("id").collect()]


def pinned(store: Store, checkpoint: str, number: int) -> int:
    """The version of the rules for a batch: the last one when it first ran, also if it runs again."""
    spark = store.spark
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/rules/{number}")
    fs = file.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(file) and fs.getFileStatus(file).getLen():
        stream = fs.open(file)
        try:
            return int(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
    version = store.snapshot().version
    stream = fs.create(file, True)
    stream.write(bytearray(str(version), "utf-8"))
    stream.close()
    return version


def ruled(rows: DataFrame, store: Store, target: str, checkpoint: str, payload: str = "payload", trigger: dict | None = None):
    """Starts a stream whose batches each go by the rules of one version of `store`,
    the last one at the batch's first run: rules that change meanwhile hold from the
    next batch on, and a batch that is run again is decided alike. Writes what is kept to
    target/kept and the number that each rule dropped to target/drops, by batch, with the rules' version."""

    def write(batch: DataFrame, number: int) -> None:
        version = pinned(store, checkpoint, number)
        kept, drops = rules.filtered(batch, listed(store.snapshot(version)), payload=payload)
        for name, part in (("kept", kept), ("drops", drops)):
            part.withColumn("rules", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")

    start = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (start.trigger(**trigger) if trigger else start).start()


def windowed(rows: DataFrame, ts: str, keys: list[str], width: str, slide: str, late: str) -> DataFrame:
    """Counts per window; rows later than the watermark are left out."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, width, slide), *keys).agg(F.count(F.lit(1)).alias("n"))


def without_repeats(rows: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def supervised(start, tries: int = 10, first: float = 1.0, most: float = 60.0, wait=None) -> int:
    """Starts a query and waits for its end; after a failure again, after a pause
    that doubles, `tries` times at most. Returns the failures it got over."""
    import time

    for failures in range(tries + 1):
        try:
            start().awaitTermination()
            return failures
        except Exception:
            if failures == tries:
                raise
            (wait or time.sleep)(min(most, first * 2**failures))
    return tries


def t1_streamed(spark, d):
    """All events through a stream into a table, which holds each once."""
    target = new_path(spark, "ingested")
    ingested(stream(spark, f"{d}/events.parquet"), target, ["event_id"], new_path(spark, "state")).awaitTermination()
    return spark.read.parquet(target).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def t8_streamed_windows(spark, d):
    """Events per tumbling hour and type, by a stream with a watermark, in append mode:
    windows that the watermark has passed."""
    out = new_path(spark, "windows")
    rows = stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = windowed(rows, "ts", ["event_type"], "1 hour", "1 hour", "2 hours")
    counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


SQL = {
    "t1_streamed": "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1",
    "t8_streamed_windows": """SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events
        GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""",
}
QUERIES = {name: globals()[name] for name in SQL}
