"""Joins that equality can't say, each as an equi-join on buckets and a residual."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import text as T


#: Keys that are joined by broadcast, at most.
HOT_KEYS = 5000


def joined(rows: DataFrame, values: DataFrame, key: str, count: str) -> DataFrame:
    """`rows.join(values, key)`, where `values` has one row for each key and in
    `count` how many of `rows` have it, which is left out of the result. Keys
    that more than one in HOT_KEYS of the rows have, so fewer than HOT_KEYS of
    them, are sent to all tasks: no task gathers a hot key's rows."""
    total = values.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
    hot = F.col(count) > max(100, total // HOT_KEYS)
    few, rest = values.where(hot).drop(count), values.where(~hot).drop(count)
    others = rows.join(F.broadcast(few.select(key)), key, "left_anti")
    return rows.join(F.broadcast(few), key).unionByName(others.join(rest, key))


def within_time_pairs(df: DataFrame, keys: list[str], ts: str, seconds: int, ident: str) -> DataFrame:
    """Pairs (a_id < b_id) with equal keys at most so many seconds apart: each row
    is filed under its time bucket and looks into its own and the two beside it."""
    rows = df.where(F.col(ts).isNotNull()).select(F.col(ident).alias("id"), *keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    rows = rows.withColumn("bucket", F.expr(f"at div {seconds * 1_000_000}"))
    left = rows.select(F.col("id").alias("a_id"), F.col("at").alias("a_at"), *keys, F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    right = rows.select(F.col("id").alias("b_id"), F.col("at").alias("b_at"), *keys, "bucket")
    apart = F.abs(F.col("a_at") - F.col("b_at"))
    return (
        left.join(right, [*keys, "bucket"]).where((F.col("a_id") < F.col("b_id")) & (apart <= seconds * 1_000_000))
        .select("a_id", "b_id", *keys, F.expr("abs(a_at - b_at) div 1000000").alias("seconds"))
    )


def relative_band_pairs(df: DataFrame, keys: list[str], value: str, tolerance: float, ident: str) -> DataFrame:
    """Pairs with equal keys whose positive values differ by a share of the larger
    one at most, over buckets of the logarithm as wide as the tolerance."""
    width = F.log(F.lit(1 / (1 - tolerance)))
    rows = df.where(F.col(value) > 0).select(F.col(ident).alias("id"), *keys, F.col(value).alias("v"))
    rows = rows.withColumn("bucket", F.floor(F.log("v") / width))
    left = rows.select(F.col("id").alias("a_id"), F.col("v").alias("a_v"), *keys, F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    right = rows.select(F.col("id").alias("b_id"), F.col("v").alias("b_v"), *keys, "bucket")
    near = F.abs(F.col("a_v") - F.col("b_v")) <= tolerance * F.greatest("a_v", "b_v")
    return left.join(right, [*keys, "bucket"]).where((F.col("a_id") < F.col("b_id")) & near).select("a_id", "b_id", *keys, "a_v", "b_v")


def overlapping_pairs(spans: DataFrame, keys: list[str], start: str, end: str, ident: str, bucket_days: int = 7) -> DataFrame:
    """Pairs (a_id < b_id) of half-open spans per key that overlap. A span is filed
    under every bucket of days it touches; a pair counts in the first bucket
    that both touch."""
    day = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
    rows = spans.where(F.col(start) < F.col(end)).select(F.col(ident).alias("id"), *keys, F.col(start).alias("s"), F.col(end).alias("e"))
    rows = rows.withColumn("first", F.floor(day(F.col("s")) / bucket_days)).withColumn("bucket", F.explode(F.sequence(F.col("first"), F.floor(day(F.col("e")) / bucket_days))))
    left = rows.select(F.col("id").alias("a_id"), F.col("s").alias("a_s"), F.col("e").alias("a_e"), F.col("first").alias("a_first"), *keys, "bucket")
    right = rows.select(F.col("id").alias("b_id"), F.col("s").alias("b_s"), F.col("e").alias("b_e"), F.col("first").alias("b_first"), *keys, "bucket")
    meet = (F.col("a_id") < F.col("b_id")) & (F.col("a_s") < F.col("b_e")) & (F.col("b_s") < F.col("a_e")) & (F.col("bucket") == F.greatest("a_first", "b_first"))
    return left.join(right, [*keys, "bucket"]).where(meet).select("a_id", "b_id", *keys)


def nearest_in_time(probes: DataFrame, fixes: DataFrame, keys: list[str], ts: str, columns: list[str], stale: int | None = None) -> DataFrame:
    """Each probe with the columns of the nearest fix of its keys, before or after;
    the one before on a tie; null beyond `stale` seconds. One sort of both."""
    fix = F.struct(F.col(ts).alias("at"), *columns)
    both = probes.withColumn("_probe", F.lit(True)).withColumn("_fix", F.lit(None)).unionByName(
        fixes.select(*keys, ts, F.lit(False).alias("_probe"), fix.alias("_fix")), allowMissingColumns=True
    )
    # at one instant, fixes count as before
    w = Window.partitionBy(*keys).orderBy(ts, "_probe")
    before = F.last("_fix", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # what comes next, as the last one of the other direction: its frame only grows
    back = Window.partitionBy(*keys).orderBy(F.desc(ts), F.desc("_probe"))
    after = F.last("_fix", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    away = lambda x: F.abs(F.unix_micros(x["at"].cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp")))
    rows = both.withColumns({"_before": before, "_after": after}).where("_probe")
    best = F.when(F.col("_before").isNull(), F.col("_after")).when(F.col("_after").isNull() | (away(F.col("_before")) <= away(F.col("_after"))), F.col("_before")).otherwise(F.col("_after"))
    near = rows.withColumn("_best", best)
    if stale is not None:
        near = near.withColumn("_best", F.when(away(F.col("_best")) <= stale * 1_000_000, F.col("_best")))
    return near.select(*probes.columns, *[F.col(f"_best.{c}").alias(f"near_{c}") for c in columns], F.col("_best.at").alias("near_at"))


def similar_names(left: DataFrame, right: DataFrame, ident: str, name: str, least: float = 0.55, same: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows of two tables whose names' trigram similarity is at least
    `least` and whose `same` columns are equal: (a_id, b_id, score). Prefix filter: with the trigrams of every set in
    one order, the rarest first, similar sets share one among the first few of
    each. Only names of a length that allows the similarity meet."""
    def each(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(ident).alias("id"), *same, T.trigrams(T.match_key(F.col(name))).alias("g"))
        return rows.select("id", *same, F.explode(F.array_distinct("g")).alias("gram"))

    a = each(left)
    b = a if left is right else each(right)
    often = (a if left is right else a.select("gram").unionByName(b.select("gram"))).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))

    def prefixes(rows: DataFrame, side: str) -> DataFrame:
        ranked = joined(rows, often.withColumn("met", F.col("n")), "gram", "met")
        sets = ranked.groupBy("id", *same).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "gram"))), lambda x: x["gram"]).alias("g"))
        few = F.size("g") - F.ceil(F.size("g") * F.lit(least)) + 1
        return sets.select(F.col("id").alias(f"{side}_id"), *same, F.col("g").alias(f"{side}_g"), F.explode(F.slice("g", F.lit(1), few.cast("int"))).alias("gram"))

    score = T.jaccard(F.col("a_g"), F.col("b_g"))
    sizes = F.least(F.size("a_g"), F.size("b_g")) >= least * F.greatest(F.size("a_g"), F.size("b_g"))
    met = prefixes(a, "a").join(prefixes(b, "b"), ["gram", *same]).where(sizes)
    if left is right:
        met = met.where("a_id < b_id")  # of a table with itself each pair once, and no row with itself
    return met.withColumn("score", score).where(F.col("score") >= least).groupBy("a_id", "b_id").agg(F.max("score").alias("score"))


def contained_names(df: DataFrame, ident: str, name: str, kind: str, least: int = 2) -> DataFrame:
    """(short_id, long_id): all words of a name of at least `least` words stand in a
    longer name of the same kind. Only the rarest word of the short name is looked up."""
    words = F.array_distinct(F.filter(F.split(T.match_key(F.col(name)), "[^a-z0-9]+"), lambda w: w != ""))
    rows = df.select(F.col(ident).alias("id"), F.col(kind).alias("kind"), words.alias("words"))
    each = rows.select("id", "kind", "words", F.explode("words").alias("word"))
    often = each.groupBy("kind", "word").agg(F.count(F.lit(1)).alias("often"))
    rare = each.join(often, ["kind", "word"]).groupBy("id").agg(F.min_by("word", F.struct("often", "word")).alias("word"), F.first("kind").alias("kind"), F.first("words").alias("short"))
    rare = rare.where(F.size("short") >= least).select(F.col("id").alias("short_id"), "kind", "short", "word")
    held = (F.size("words") > F.size("short")) & (F.size(F.array_except("short", "words")) == 0)
    return rare.join(each.withColumnRenamed("id", "long_id"), ["kind", "word"]).where(held).select("short_id", "long_id", "kind")


def pairs_in_groups(df: DataFrame, group: str, member: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of members that meet in a group, with the number of groups and the
    first of them, from groups of at most `most` distinct members; and the larger groups."""
    members = df.select(group, member).where(F.col(member).isNotNull()).distinct()
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    few = members.join(sizes.where(F.col("size").between(2, most)), group).groupBy(group).agg(F.array_sort(F.collect_list(member)).alias("_m"))
    each = few.select(group, "_m", F.posexplode("_m").alias("_k", "a")).select(group, "a", F.explode(F.slice("_m", F.col("_k") + 2, most)).alias("b"))
    pairs = each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("groups"), F.min(group).alias("first_group"))
    return pairs, sizes.where(F.col("size") > most)
