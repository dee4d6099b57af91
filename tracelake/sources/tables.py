"""The driver's tables in the roles that the operators know.

events are telemetry and messages, orders with customers are transactions,
documents are mail with `source` as the sender, labels are marks on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, customer, status, amount (decimal), at, priority."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("priority"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, sender, lang, n_chars, relevant, blocked: mail with its marks, if any."""
    marks = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("relevant"), (F.col("toxic") == 1).alias("blocked"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("sender"), "lang", "n_chars")
    return docs.join(marks, "doc_id", "left")
