"""Tables between the steps of a job, in a folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Local sessions' own folders, by application.
_LOCAL: dict[str, str] = {}
#: Paths of written tables that are still there.
_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the context's checkpoint folder. A
    local session without either gets a temporary one; a cluster must name one,
    since its machines don't see each other's folders."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='tracelake-')}"
        base = _LOCAL[context.applicationId]
    return f"{base.rstrip('/')}/tracelake"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again: cuts the
    lineage with files that outlive any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that was written, once no plan reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def written_so_far() -> list[str]:
    """Paths of the tables that this process has written and not removed."""
    return list(_WRITTEN)


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` behind a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
