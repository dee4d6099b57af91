"""The training-data pipeline: four stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in the shared folder and read again as the next stage's `docs`. The
first three drop documents and keep all columns; the last adds token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import decontaminate, sentencepiece_tok, simhash, toxicity
from tracelake.llm.common import table
from tracelake.shared import removed, written, written_so_far


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labels of these documents, scores under 0.5."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of linked fingerprints."""
    return simhash.kept_documents(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ids, n_tokens, round_trip and same_ids."""
    return sentencepiece_tok.encoded(docs, check=True, compare=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", tokens_stage),
]

#: The network and the tokenizer can't be said in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on `documents`. What a stage wrote for
    itself, and its input, go once its result is written."""
    docs, others = table(spark, sf_dir, "documents"), set(written_so_far())
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        *own, _ = (path for path in written_so_far() if path not in others)
        for path in own:
            removed(spark, path)
    return STAGES[-1][1](spark, docs, sf_dir)
