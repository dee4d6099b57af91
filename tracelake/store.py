"""Tables that change, as versions in the shared folder.

A store holds several tables that change together. Each table is cut into buckets by
a hash of some of its columns; a change writes the buckets it touches anew, beside
the old ones, and then one small file that names every bucket's folder: the version.
That file is made in one step that fails if another writer made that version first,
so a version is there wholly or not at all, and a writer that is lost leaves the
version before it as it was. Readers keep to the version they began with until it is
expired. The driver holds folder names, as many as there are buckets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelake.shared import removed, written

#: Files of a bucket at least, and rows of a file, about: one bucket's rows are so many tasks' work.
SPREAD = 4
ROWS_OF_A_FILE = 1_000_000


class Conflict(RuntimeError):
    """Another writer made the next version first."""


@dataclass(frozen=True)
class Table:
    """Columns as DDL, those that tell a row (never null), and those by which rows are dealt to buckets."""

    ddl: str
    keys: tuple[str, ...]
    by: tuple[str, ...]

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)


@dataclass(frozen=True)
class Snapshot:
    store: Store
    version: int
    folders: dict[str, dict[str, str]] = field(default_factory=dict)

    def table(self, name: str, touching: DataFrame | None = None) -> DataFrame:
        """The table's rows; with `touching`, rows with the columns it is dealt by, at
        least those that a join with them needs: other buckets aren't read."""
        table, held = self.store.tables[name], self.folders.get(name, {})
        buckets = held.keys() if touching is None else self.store.buckets_of(name, touching) & held.keys()
        reader = self.store.spark.read.schema(table.schema)
        paths = [f"{self.store.path}/{held[b]}" for b in sorted(buckets, key=int)]
        return reader.parquet(*paths) if paths else self.store.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema]).where(F.lit(False))


class Store:
    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table], buckets: int = 16) -> None:
        self.spark, self.path, self.tables, self.buckets = spark, path.rstrip("/"), tables, buckets

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*self.tables[name].by), F.lit(self.buckets)).cast("int")

    def buckets_of(self, name: str, rows: DataFrame) -> set[str]:
        return {str(r[0]) for r in rows.select(self.bucket(name).alias("b")).distinct().collect()}

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _file(self, version: int) -> str:
        return f"{self.path}/versions/{version:012d}.json"

    def versions(self) -> list[int]:
        """Numbers of the versions that are there, ascending."""
        fs, folder = self._fs(f"{self.path}/versions")
        if not fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(folder) if s.getLen() > 0)
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A version, the last one by default; version 0 is the empty store."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return Snapshot(self, 0)
        fs, file = self._fs(self._file(version))
        stream = fs.open(file)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Snapshot(self, version, json.loads(text))

    def commit(self, base: Snapshot, changes: dict[str, DataFrame]) -> Snapshot:
        """The version after `base`. Changes have a table's columns and `gone`, which is
        true for rows to delete; others are put in place of the row with their keys, of which there is one change at most."""
        folders = {name: dict(held) for name, held in base.folders.items()}
        for name, change in changes.items():
            table, here = self.tables[name], f"data/{name}-{uuid.uuid4().hex}"
            change = written(change.select(*table.schema.names, F.coalesce("gone", F.lit(False)).alias("gone")), f"change-{name}")
            touched = self.buckets_of(name, change)
            if not touched:
                continue
            kept = Snapshot(self, base.version, {name: {b: f for b, f in base.folders.get(name, {}).items() if b in touched}}).table(name)
            rows = change.unionByName(kept.withColumn("gone", F.lit(None).cast("boolean")))
            spread = max(SPREAD, rows.count() // (ROWS_OF_A_FILE * len(touched)))
            dealt = rows.withColumns({"_bucket": self.bucket(name), "_part": F.pmod(F.xxhash64(*table.keys), F.lit(spread))}).repartition("_bucket", "_part")
            if touched & base.folders.get(name, {}).keys():
                # the one shuffle brings old and new rows of a key together: `gone` is null in old ones, which come last
                turn = Window.partitionBy("_bucket", "_part", *table.keys).orderBy(F.col("gone").asc_nulls_last())
                dealt = dealt.withColumn("_turn", F.row_number().over(turn)).where("_turn = 1").drop("_turn")
            dealt = dealt.where("gone IS NULL OR NOT gone").drop("gone", "_part")
            dealt.write.partitionBy("_bucket").parquet(f"{self.path}/{here}")
            fs, folder = self._fs(f"{self.path}/{here}")
            made = {s.getPath().getName().removeprefix("_bucket=") for s in fs.listStatus(folder) if s.isDirectory()}
            held = {b: f for b, f in folders.get(name, {}).items() if b not in touched}
            folders[name] = held | {b: f"{here}/_bucket={b}" for b in made}
        return self._published(base.version + 1, folders)

    def _published(self, version: int, folders: dict) -> Snapshot:
        fs, file = self._fs(self._file(version))
        try:
            stream = fs.create(file, False)
        except Exception as taken:
            if fs.exists(file):
                raise Conflict(f"version {version} is there already") from taken
            raise
        stream.write(bytearray(json.dumps(folders), "utf-8"))
        stream.close()
        return Snapshot(self, version, folders)

    def expire(self, keep: int) -> None:
        """Deletes all but the last versions, and the folders that only these name."""
        versions = self.versions()
        old, rest = versions[: -keep or None], versions[-keep:] if keep else []
        named: Iterable[str] = {f for v in rest for held in self.snapshot(v).folders.values() for f in held.values()}
        for v in old:
            for held in self.snapshot(v).folders.values():
                for folder in set(held.values()) - named:
                    removed(self.spark, f"{self.path}/{folder}")
            removed(self.spark, self._file(v))
