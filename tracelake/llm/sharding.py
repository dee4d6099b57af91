"""Shards of near equal bytes: sampled splitters, ranges of keys, exact edges.

Rows are ordered by a digest of their text and then by id, so equal texts stand
together and the order doesn't depend on how the table is dealt. A sample in which
a row's chance grows with its size gives the quantiles at which the order is cut
into ranges; a range that turns out overfull, in bytes or in rows, is cut again at
quantiles of a sample of its own. Ranges are the unit of work: their exact sizes,
a small table, give each row its place among all bytes, and where an edge between
two shards falls into a range, the rows on both sides of it are told apart by
that place. So the shards' sizes differ by rows or small groups at an edge, not by
sampling error, and the result doesn't depend on the sample.

A group of equal texts of at most a KEEP-th of a shard goes whole to the shard of
its middle; a larger one, however many rows it has, is cut between its rows.

The driver holds the cuts and the sizes of the ranges, some tens of bytes for
every RANGE_ROWS rows, and no more.

Only DataFrame functions; texts are read once and never shuffled.

Defined results: a null text has no bytes and the crc32 of none, and counts as
equal to an empty one; null ids come first among equal texts; repeated rows are
aggregated, with their number, and told apart again at the end; an empty table
has no rows. Further columns are not returned.
"""

from __future__ import annotations

from bisect import bisect_right
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.common import table
from tracelake.shared import written

SHARDS = 40

#: Bytes that a row has beside its text's.
ROW = 16

#: A group of equal texts up to 1/KEEP of a shard isn't cut.
KEEP = 20

#: Rows of a range on average, ranges of a shard at least, rows of the sample for each range.
RANGE_ROWS, SHARD_RANGES, SAMPLED = 2_000_000, 4, 32

#: A range is overfull beyond so many times the mean.
OVERFULL = 2

#: Characters of a key.
KEY = 32


def records(docs: DataFrame) -> DataFrame:
    """(key, id, size, crc, copies): a row for each different text and id."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.md5(text).alias("key"), F.col("doc_id").cast("long").alias("id"), (F.octet_length(text) + ROW).cast("long").alias("size"), F.crc32(text).alias("crc"))
    return rows.groupBy("key", "id", "size", "crc").agg(F.count(F.lit(1)).alias("copies"))


def place() -> Column:
    """A row's place in the order, as a string that sorts like it: the key, then the
    id with its sign bit turned; a null id is shorter, so it comes first."""
    return F.concat("key", F.coalesce(F.lpad(F.hex(F.col("id").bitwiseXOR(F.lit(-(2**63)))), 16, "0"), F.lit("")))


def sampled(rows: DataFrame, rate: Column) -> DataFrame:
    """Rows that are drawn with the chance load * rate, by a hash, so the same ones at every run."""
    return rows.where(F.pmod(F.xxhash64("key", "id"), F.lit(2**53)) / float(2**53) < F.col("load") * rate)


def quantiles(sample: DataFrame, pieces: Column) -> list[str]:
    """The places that cut the sample of each range into so many pieces."""
    group = Window.partitionBy("range")
    ranked = sample.withColumn("_r", F.row_number().over(group.orderBy("place")) - 1).withColumn("_n", F.count(F.lit(1)).over(group))
    piece = lambda r: F.floor(r * pieces / F.col("_n"))
    return [r["place"] for r in ranked.where((F.col("_r") > 0) & (piece(F.col("_r")) > piece(F.col("_r") - 1))).select("place").collect()]


def aligned(cuts: set[str]) -> list[str]:
    """The cuts in order. The first one within equal texts is moved to their start, so that only large groups are cut."""
    out: list[str] = []
    for cut in sorted(cuts):
        out.append(cut if out and out[-1][:KEY] == cut[:KEY] else cut[:KEY])
    return out


def range_of(cuts: list[str]) -> Column:
    """The number of cuts up to a row's place: among every so many-th cut first, then among those that follow it."""
    if not cuts:
        return F.lit(0)
    step = ceil(len(cuts) ** 0.5)
    blocks = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    first = F.size(F.filter(F.lit([b[0] for b in blocks]), lambda c: c <= F.col("place")))  # 0: before all
    return F.when(first == 0, 0).otherwise((first - 1) * step + F.size(F.filter(F.get(F.lit(blocks), first - 1), lambda c: c <= F.col("place"))))


def ranges(rows: DataFrame, loads: float, number: int) -> tuple[list[str], list]:
    """Cuts of the order, and (load, records, bytes, copies) of each range between
    them: quantiles of a sample, then, while a range is overfull, of one of its own."""
    target = loads / number
    cuts = set(quantiles(sampled(rows.withColumn("range", F.lit(0)), F.lit(SAMPLED / target)), F.lit(number)))
    whole: set[int] = set()
    while True:
        order = aligned(cuts)
        dealt = rows.withColumn("range", range_of(order))
        got = dealt.groupBy("range").agg(F.sum("load").alias("load"), F.count(F.lit(1)).alias("n"), F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("copies")).collect()
        sizes = {r["range"]: r for r in got}
        over = {k: ceil(r["load"] / target) for k, r in sizes.items() if r["load"] > OVERFULL * target and r["n"] > 1}
        pieces = [max(1, over.get(k, 1)) for k in range(len(order) + 1)]
        rates = [float(SAMPLED * pieces[k] / sizes[k]["load"]) if k in over else 0.0 for k in range(len(order) + 1)]
        new = set(quantiles(sampled(dealt, F.get(F.lit(rates), F.col("range"))), F.get(F.lit(pieces), F.col("range")))) - cuts if over else set()
        if not new or aligned(cuts | new) == order:
            return order, [sizes.get(k) for k in range(len(order) + 1)]
        cuts |= new


def sharded(docs: DataFrame, shards: int = SHARDS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row."""
    rows = written(records(docs), "shard-records")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("size") * F.col("copies")), F.lit(0)).alias("bytes")).first()
    # a row's load: its bytes, and as much as a row has on average, so that ranges are bounded in bytes and in rows
    mean = total["bytes"] / max(1, total["n"])
    rows = rows.select("*", place().alias("place"), (F.col("size") * F.col("copies") + F.lit(mean)).alias("load"))
    number = max(SHARD_RANGES * shards, total["n"] // range_rows)
    cuts, sizes = ranges(rows, 2.0 * max(1, total["bytes"]), number)
    before, first = [0], [0]
    for r in sizes:
        before.append(before[-1] + (r["bytes"] if r else 0))
        first.append(first[-1] + (r["copies"] if r else 0))

    own = F.col("size") * F.col("copies")
    order, group = Window.partitionBy("range").orderBy("place"), Window.partitionBy("range", "key")
    placed = rows.withColumn("range", range_of(cuts)).withColumns({
        "start": F.get(F.lit(before), F.col("range")) + F.sum(own).over(order.rowsBetween(Window.unboundedPreceding, 0)) - own,
        "rank": F.get(F.lit(first), F.col("range")) + F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies"),
    })
    placed = placed.withColumns({"_bytes": F.sum(own).over(group), "_start": F.min("start").over(group)})
    split = sorted({c[:KEY] for c in cuts if len(c) > KEY})  # groups of several ranges: they start where the first of them does
    if split:
        held = {r["key"]: r["bytes"] for r in rows.where(F.col("key").isin(split)).groupBy("key").agg(F.sum(own).alias("bytes")).collect()}
        of = lambda values: F.try_element_at(F.create_map(*[x for k in held for x in (F.lit(k), F.lit(values(k)))]), F.col("key"))
        starts = {k: before[bisect_right(cuts, k)] for k in held}
        placed = placed.withColumns({"_bytes": F.coalesce(of(held.get), "_bytes"), "_start": F.coalesce(of(starts.get), "_start")})

    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumns({
        "start": F.col("start") + F.col("copy") * F.col("size"), "rank": F.col("rank") + F.col("copy"),
    })
    shard = lambda start, size: F.expr(f"CAST((2 * {start} + {size}) * {shards} div {2 * max(1, total['bytes'])} AS INT)")  # noqa: E731  of a middle
    kept = F.col("_bytes") * KEEP * shards <= total["bytes"]
    each = each.withColumn("shard", F.when(kept, shard("_start", "_bytes")).otherwise(shard("start", "size")))
    each = written(each.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), "shard", "rank"), "shards")
    edges = {r["shard"]: r["first"] for r in each.groupBy("shard").agg(F.min("rank").alias("first")).collect()}
    starts = F.lit([edges.get(k, 0) for k in range(shards)])
    return each.select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.get(starts, F.col("shard"))).alias("slot"))


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards of near equal bytes."""
    got = sharded(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
