"""Append-only ingestion: keys seen once, counters, windows of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.latest import first_per_key
from tracelake.shared import written


def new_records(batch: DataFrame, table: DataFrame, keys: list[str], order: list[Column], content: str | None = None, seen: DataFrame | None = None) -> DataFrame:
    """The first record of each key that the table lacks; with `content`, an array
    of content keys, only records none of whose keys were seen before, and of
    several in the batch that share one the first."""
    rows = first_per_key(batch, keys, order).join(table.select(*keys), keys, "left_anti")
    if content is None:
        return rows
    each = rows.select(*keys, F.explode(content).alias("key"), F.struct(*order_columns(order), *keys).alias("_at"))
    owner = each.groupBy("key").agg(F.min("_at").alias("_first"))
    taken = each.join(owner, "key").where(F.col("_at") != F.col("_first")).select(*keys)
    if seen is not None:
        taken = taken.unionByName(each.join(seen.select("key"), "key", "left_semi").select(*keys))
    return rows.join(taken.distinct(), keys, "left_anti")


def order_columns(order: list[Column]) -> list[Column]:
    return [c.alias(f"_o{i}") for i, c in enumerate(order)]


def outcomes(batch: DataFrame, kept: DataFrame, inserted: DataFrame, keys: list[str], broken: Column) -> DataFrame:
    """posted = inserted + duplicates + filtered + errors, in one row."""
    mark = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    rows = batch.withColumn("_broken", F.coalesce(broken, F.lit(False))).join(mark(kept, "_kept"), keys, "left").join(mark(inserted, "_new"), keys, "left")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))) == 1
    rows = rows.withColumn("_outcome", F.when(F.col("_broken"), "errors").when(F.col("_kept").isNull(), "filtered").when(F.col("_new") & first, "inserted").otherwise("duplicates"))
    names = ("inserted", "duplicates", "filtered", "errors")
    return rows.agg(F.count(F.lit(1)).alias("posted"), *[F.count_if(F.col("_outcome") == n).alias(n) for n in names])


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`df` with `place`, each row's number in its key by the order, from 0. Rows are
    dealt by ranges of key and order, so a key with very many is many tasks' work:
    places within a range, and the sizes of a key's ranges before it."""
    spread = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    rows = written(spread, "ranges")  # written, so that a row's range stays what it is
    sizes = rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_n")
    starts = sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_r"), before.alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.withColumn("_place", place).join(starts, same).select(*df.columns, (F.col("_place") + F.col("_before")).alias("place"))


def count_windows(df: DataFrame, source: str, order: list[str], size: int, alone: Column | None = None) -> DataFrame:
    """Rows of a source in order, `size` to a window (window_no from 0); rows that
    are to go alone make windows of one."""
    alone = F.coalesce(alone, F.lit(False)) if alone is not None else F.lit(False)
    rows = numbered(df.withColumn("alone", alone), [source, "alone"], order)
    place = F.col("place")
    return rows.withColumn("window_no", F.when(F.col("alone"), place).otherwise(F.floor(place / size)).cast("long")).drop("place")


def pending(df: DataFrame, done: list[DataFrame], key: str) -> DataFrame:
    """Rows with no row in any of the done tables: absence means pending."""
    for table in done:
        df = df.join(table.select(key).distinct(), key, "left_anti")
    return df


def merged_facts(df: DataFrame, keys: dict[str, Column], provenance: str) -> DataFrame:
    """Facts with equal keys, null equal to null, as one with all their source ids."""
    return df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(provenance)))).alias(provenance), F.count(F.lit(1)).alias("merged"))


def forgotten(facts: DataFrame, ids: list[int], provenance: str) -> DataFrame:
    """Facts without some sources' contribution; those that lose their last one go."""
    gone = F.array(*[F.lit(i).cast("long") for i in ids])
    touched = F.arrays_overlap(provenance, gone)
    left = F.array_except(provenance, gone)
    return facts.where(~touched | (F.size(left) > 0)).withColumn(provenance, F.when(touched, left).otherwise(F.col(provenance)))


def dead_letters(failures: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """Failures per item; at the third it goes to review."""
    counted = failures.groupBy(*keys).agg(F.count(F.lit(1)).alias("attempts"))
    return counted.withColumn("status", F.when(F.col("attempts") >= most, "review").otherwise("retry"))


def job_windows(jobs: DataFrame) -> DataFrame:
    """(source, window_start, window_end) of backfill jobs (source, range_start,
    range_end, unit): days, weeks or months from the start, the last window cut at the
    end; months are counted from the start, so a clamped day doesn't drift."""
    step = lambda i: F.when(F.col("unit") == "day", F.date_add("range_start", i)).when(F.col("unit") == "week", F.date_add("range_start", i * 7)).otherwise(F.add_months("range_start", i))
    days = F.datediff("range_end", "range_start")
    most = F.when(F.col("unit") == "day", days).when(F.col("unit") == "week", F.ceil(days / 7)).otherwise(F.ceil(F.months_between("range_end", "range_start")) + 1)
    rows = jobs.where("range_start < range_end").select("*", F.explode(F.sequence(F.lit(0), most.cast("int"))).alias("_i"))
    windows = rows.select("source", "range_end", step(F.col("_i")).alias("window_start"), F.least(step(F.col("_i") + 1), "range_end").alias("window_end"))
    return windows.where("window_start < range_end").drop("range_end")


def new_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs with the frontier at their start and nothing done."""
    return jobs.select("*", F.col("range_start").alias("frontier"), F.lit("active").alias("status"), F.lit(0).cast("long").alias("windows"), F.lit(0).cast("long").alias("posted"))


def advanced_jobs(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs after a run over the windows from their frontier on: it moves over the
    windows before the first one that failed, which the next run begins with, and
    what these posted is added. `results`: (source, window_start, window_end, posted,
    failed); a window without a result is one that had nothing to post."""
    ahead = job_windows(jobs).join(jobs.select("source", "frontier"), "source").where("window_start >= frontier").drop("frontier")
    rows = ahead.join(results.select("source", "window_start", "posted", F.coalesce("failed", F.lit(False)).alias("failed")), ["source", "window_start"], "left")
    stops = rows.groupBy("source").agg(F.min(F.when(F.col("failed"), F.col("window_start"))).alias("_stop"))
    moved = rows.join(stops, "source").where("_stop IS NULL OR window_start < _stop")
    gained = moved.groupBy("source").agg(F.max("window_end").alias("_to"), F.count(F.lit(1)).alias("_windows"), F.coalesce(F.sum("posted"), F.lit(0)).alias("_posted"))
    after = jobs.join(gained, "source", "left").withColumn("frontier", F.coalesce("_to", "frontier"))
    return after.select(
        *[c for c in jobs.columns if c not in ("frontier", "status", "windows", "posted")], "frontier", F.when(F.col("frontier") >= F.col("range_end"), "done").otherwise("active").alias("status"),
        (F.col("windows") + F.coalesce("_windows", F.lit(0))).alias("windows"), (F.col("posted") + F.coalesce("_posted", F.lit(0))).alias("posted"),
    )
