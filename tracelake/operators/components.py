"""Connected components of a link table, wholly in Spark.

Alternating large-star and small-star rounds: each needs a minimum per vertex
(pre-aggregated before its shuffle) and a join that carries it back to the
vertex's links. The vertices with the most links, a bounded number, are joined by
broadcast, so a vertex with very many links is never gathered in one task.
The links shrink towards stars and are written to the shared folder each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.joins import joined
from tracelake.shared import new_path, removed


def _signature(links: DataFrame) -> tuple:
    """Two numbers that change if the set of links does."""
    row = links.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h"),
    ).first()
    return row["n"], row["h"]


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is linked to its smallest one."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n")).withColumn("low", F.least("a", "low"))
    return joined(both, least, "a", "n").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n"))
    moved = joined(links, least, "a", "n").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(least.select("a", F.col("low").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links between longs -> one row (vertex, root) per linked vertex
    that is not itself the smallest of its component. Unlinked vertices, null
    ends and links of a vertex to itself give no row; an empty table gives none.
    """
    spark = links.sparkSession
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path = new_path(spark, "links")
    links.write.parquet(path)
    links = spark.read.schema(links.schema).parquet(path)
    before = _signature(links)
    while before[0]:
        for star in (_large_star, _small_star):
            after_path = new_path(spark, "links")
            star(links).write.parquet(after_path)
            links = spark.read.schema(links.schema).parquet(after_path)
            removed(spark, path)
            path = after_path
        after = _signature(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
