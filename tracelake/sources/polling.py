"""A source that is polled: records of accounts, read on from a cursor.

Registered with Spark's Python data sources as `polled`: as a batch source it takes
conditions on the id and the account into its reader; as a stream it has offsets of
its own, reads accounts in parallel, and moves its stored cursor only when a batch's
sink is done. Records' ids grow with time; the newest one is known from the files'
footers. Options: path, id, account (a whole number), shards (tasks of a batch),
limit (ids of a batch), cursor (a file; without it a stream begins at the first record).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType


class Slice(InputPartition):
    """Accounts of one remainder with ids in (low, high]."""

    def __init__(self, shard: int, low: int, high: int) -> None:
        self.shard, self.low, self.high = shard, low, high


class Feed:
    """The files behind a source."""

    def __init__(self, options: dict) -> None:
        self.path, self.ident, self.account = options["path"], options.get("id", "id"), options.get("account", "account")
        self.shards, self.limit, self.cursor = int(options.get("shards", 4)), int(options.get("limit", 1_000_000)), options.get("cursor")

    def files(self) -> ds.Dataset:
        return ds.dataset(self.path.removeprefix("file://"), format="parquet", partitioning=None)

    def newest(self) -> int:
        """The largest id, by the row groups' statistics."""
        most = -1
        for fragment in self.files().get_fragments():
            for group in fragment.row_groups:
                most = max(most, (group.statistics or {}).get(self.ident, {}).get("max", -1))
        return most

    def read(self, part: Slice, columns: list[str], more: Iterable[pc.Expression] = ()) -> Iterator[pa.RecordBatch]:
        ident, account, n = pc.field(self.ident), pc.field(self.account), pa.scalar(self.shards, pa.int64())
        wanted = (ident > part.low) & (ident <= part.high) & (pc.subtract(account, pc.multiply(pc.divide(account, n), n)) == part.shard)
        for condition in more:
            wanted &= condition
        for batch in self.files().scanner(columns=columns, filter=wanted).to_batches():
            if batch.num_rows:
                yield batch

    def stored(self) -> int:
        file = Path(self.cursor.removeprefix("file://")) if self.cursor else None
        return json.loads(file.read_text())["at"] if file and file.exists() else -1

    def store(self, at: int) -> None:
        if self.cursor:
            file = Path(self.cursor.removeprefix("file://"))
            file.parent.mkdir(parents=True, exist_ok=True)
            new = file.with_suffix(".new")
            new.write_text(json.dumps({"at": at}))
            new.replace(file)


class PolledReader(DataSourceReader):
    TESTS = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    def __init__(self, options: dict, schema: StructType) -> None:
        self.feed, self.columns, self.conditions = Feed(options), schema.names, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of the id and the account; Spark applies the others."""
        for f in filters:
            if type(f) in self.TESTS and len(f.attribute) == 1 and f.attribute[0] in (self.feed.ident, self.feed.account):
                self.conditions.append((f.attribute[0], self.TESTS[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        only = {v % self.feed.shards for name, test, v in self.conditions if name == self.feed.account and test == "=="}
        return [Slice(k, -1, 2**62) for k in range(self.feed.shards) if not only or k in only]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        tests = {"==": "__eq__", ">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__"}
        return self.feed.read(part, self.columns, [getattr(pc.field(name), tests[test])(value) for name, test, value in self.conditions])


class PolledStream(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.feed, self.columns = Feed(options), schema.names
        self.at = self.feed.stored()

    def initialOffset(self) -> dict:
        return {"at": self.feed.stored()}

    def latestOffset(self) -> dict:
        """As far as a batch may go from what the sink has."""
        return {"at": max(self.at, min(self.feed.newest(), self.at + self.feed.limit))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["at"])
        return [Slice(k, start["at"], end["at"]) for k in range(self.feed.shards)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        return self.feed.read(part, self.columns)

    def commit(self, end: dict) -> None:
        """Called when the sink has the batch."""
        self.at = max(self.at, end["at"])
        self.feed.store(end["at"])


class Polled(DataSource):
    @classmethod
    def name(cls) -> str:
        return "polled"

    def schema(self) -> StructType:
        return from_arrow_schema(Feed(self.options).files().schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return PolledReader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PolledStream(self.options, schema)


def registered(spark: SparkSession) -> SparkSession:
    """The session with the source `polled`; conditions reach its reader."""
    spark.dataSource.register(Polled)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark
