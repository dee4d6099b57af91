"""Duplicates among transactions: pairs, scores, components, winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators.components import components
from tracelake.operators.joins import within_time_pairs
from tracelake.operators.latest import first_per_key
from tracelake.shared import written
from tracelake.store import Snapshot, Store, Table


def scored_pairs(df: DataFrame, ident: str, ts: str, same: list[str], worth: dict[str, float], base: float, seconds: int, confirmed: float = 0.85, candidate: float = 0.40) -> DataFrame:
    """Pairs with equal `same` columns close in time; each further equal column
    adds its worth to the score; bands confirmed and candidate, the rest goes."""
    pairs = within_time_pairs(df, same, ts, seconds, ident)
    side = lambda p: df.select(F.col(ident).alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in worth])
    rows = pairs.select("a_id", "b_id", "seconds").join(side("a"), "a_id").join(side("b"), "b_id")
    score: Column = F.lit(base)
    for c, w in worth.items():
        score = score + F.when(F.col(f"a_{c}") == F.col(f"b_{c}"), w).otherwise(0.0)
    rows = rows.select("a_id", "b_id", "seconds", F.round(score, 3).alias("score"))
    return rows.withColumn("status", F.when(F.col("score") >= confirmed, "confirmed").when(F.col("score") >= candidate, "candidate")).where("status IS NOT NULL")


def incremental(pairs: DataFrame, new_ids: DataFrame) -> DataFrame:
    """Pairs with a new row on one side at least."""
    new = new_ids.select(F.col("id"), F.lit(True).alias("_new"))
    a, b = new.select(F.col("id").alias("a_id"), F.col("_new").alias("_a")), new.select(F.col("id").alias("b_id"), F.col("_new").alias("_b"))
    return pairs.join(a, "a_id", "left").join(b, "b_id", "left").where("_a OR _b").drop("_a", "_b")


def grouped(rows: DataFrame, ident: str, pairs: DataFrame) -> DataFrame:
    """(id, root): the smallest id over the links of the pairs, which are longs."""
    roots = components(pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))).withColumnRenamed("vertex", "id")
    return rows.select(F.col(ident).alias("id")).distinct().join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def winners(rows: DataFrame, group: str, order: list[Column], fill: list[str]) -> DataFrame:
    """The best row of each group, its empty columns filled from the next best that has them."""
    best = first_per_key(rows, [group], order)
    rank = F.struct(*[F.row_number().over(_by(group, order)).alias("r")])
    ranked = rows.withColumn("_rank", rank["r"])
    filled = ranked.groupBy(group).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_rank"))).alias(f"_{c}") for c in fill], F.count(F.lit(1)).alias("members"))
    return best.join(filled, group).withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in fill}).drop(*[f"_{c}" for c in fill])


def _by(group: str, order: list[Column]):
    from pyspark.sql import Window

    return Window.partitionBy(group).orderBy(*order)


#: Groups by their members and by their roots, so that both are found without reading all of them.
GROUP_TABLES = {"by_id": Table("id long, root long", ("id",), ("id",)), "by_root": Table("root long, id long", ("root", "id"), ("root",))}


def extended(store: Store, base: Snapshot, new: DataFrame, pairs: DataFrame) -> tuple[Snapshot, DataFrame]:
    """The stored groups after new ids (id) and pairs (a_id, b_id), and what changed
    (id, root): as if all pairs so far were grouped at once, but only groups that a
    new pair touches are read, and only the members of those that get another root
    are written. A group's root is its smallest id."""
    pairs = written(pairs.select("a_id", "b_id"), "new-pairs")
    ends = written(new.select("id").unionByName(pairs.select(F.col("a_id").alias("id"))).unionByName(pairs.select(F.col("b_id").alias("id"))).distinct(), "ends")
    known = base.table("by_id", ends).join(ends, "id", "left_semi")
    roots = written(ends.join(known, "id", "left").select("id", F.coalesce("root", "id").alias("root"), F.col("root").isNull().alias("fresh")), "roots")
    of = lambda side: roots.select(F.col("id").alias(f"{side}_id"), F.col("root").alias(side))
    links = pairs.join(of("a"), "a_id").join(of("b"), "b_id").where("a <> b").select("a", "b")
    moved = written(components(links).select(F.col("vertex").alias("root"), F.col("root").alias("to")), "moved")
    members = base.table("by_root", moved).join(moved, "root").select("id", F.col("root").alias("before"), F.col("to").alias("root"))
    fresh = roots.where("fresh").join(moved, "root", "left").select("id", F.lit(None).cast("long").alias("before"), F.coalesce("to", "root").alias("root"))
    changed = written(members.unionByName(fresh), "regrouped")
    put = lambda rows, gone: rows.withColumn("gone", F.lit(gone))
    leaving = put(changed.where("before IS NOT NULL").select(F.col("before").alias("root"), "id"), True)
    after = store.commit(base, {"by_id": put(changed.select("id", "root"), False), "by_root": put(changed.select("root", "id"), False).unionByName(leaving)})
    return after, changed.select("id", "root")
