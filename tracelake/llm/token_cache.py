"""Token counts behind a digest cache.

The cache is a table of (digest, tokenizer, n_tokens): the digest of the text as
the tokenizer sees it, the digest of the tokenizer's file, the count. A run
joins the texts' digests with it, encodes each distinct missing text once,
appends what is new and joins again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import slices, table
from tracelake.llm.sentencepiece_tok import default_model
from tracelake.shared import new_path, written

CACHE = "digest string, tokenizer string, n_tokens long"
#: Bytes encoded at once (or one text), which bounds the memory of a batch.
BATCH_BYTES = 1 << 18


def version(tokenizer: str) -> str:
    """Digest of the tokenizer's file: another file never meets this one's counts."""
    with open(tokenizer, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@lru_cache(maxsize=2)
def _counter(tokenizer: str):
    if tokenizer.endswith(".json"):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(tokenizer)
        library.no_truncation()
        library.no_padding()
        return lambda texts: [len(e) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
    return lambda texts: [len(ids) for ids in library.encode(texts, num_threads=1)]


def _encoded(missing: DataFrame, tokenizer: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer)
        for batch in batches:
            for part in slices(batch, 1, BATCH_BYTES):
                counts = count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return missing.mapInArrow(run, "digest string, n_tokens long")


def _cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table, empty where none is there yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(CACHE).parquet(path)
    return spark.createDataFrame([], CACHE)


def token_counts(docs: DataFrame, cache_path: str, tokenizer: str | None = None, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of `docs`.

    A null text counts as an empty one: no bytes, and the tokens that the
    library gives an empty text. Repeated rows and ids, and null ids, each give
    a row. Other columns play no part. Only texts whose digest the cache lacks
    are encoded, each distinct one once; their counts are appended to
    `cache_path`. Copies, however many, are brought together by their digest
    with a partial aggregation before the shuffle.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or default_model()
    this = version(tokenizer)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # These tokenizers' own normalisers see every byte, so the digest is of the bytes as they are.
    digest = F.sha2(text.cast("binary"), 256)

    def known() -> DataFrame:
        rows = _cache(spark, cache_path).where(F.col("tokenizer") == this)
        return rows.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    # Copies come together before anything is looked up: an anti-join would be
    # pushed below the aggregation and carry every copy through its shuffle.
    distinct = docs.select(digest.alias("digest"), text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    there = known().select("digest", F.lit(True).alias("there"))
    missing = distinct.join(there, "digest", "left").where("there IS NULL").drop("there")
    new = _encoded(missing, tokenizer)
    new.select("digest", F.lit(this).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    rows = docs.select(F.col("doc_id").cast("long"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    # The counts are written first, so that the join is between two plain shuffles, which Spark splits where many copies meet.
    return rows.join(written(known(), "token-counts"), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """All of `documents`, with a cache of its own that starts empty."""
    return token_counts(table(spark, sf_dir, "documents"), new_path(spark, "token-cache"))
