"""Product codes of vectors by filtering Lloyd: exact k-means rounds over kd-trees.

A vector's components become integers, floor(SCALE * x), and the vector is cut into
PARTS parts, each with a codebook of its own. Once, every task builds a balanced
kd-tree over each part of its rows, BLOCK rows at a time, with each node's bounding
box and the sum of its rows, and writes it to the shared folder, so a lost executor
costs no more than reading a block again. In a round, a node starts with the entries
that its parent kept; an entry goes if another one is nearer to every place in the
node's box (or as near, with a lower index, so that ties end as they would row by
row); a node with one entry left gives it its sum and count without looking at its
rows. Only sums and counts, as many as the codebooks have components, leave the
tasks. The last pass assigns every part in the same way. All numbers are integers,
so the result is that of looking at all entries for all rows.

Defined results: rows whose vector is null, empty or holds a null or a non-finite
component take no part, nor do those of another length than the first one's (the
least vec_id's); a length that PARTS doesn't divide is an error, and so are
components of 2^SIZE / SCALE or more, whose distances a long can't hold. Null ids
come last; rows with equal ids stand in the order of their vectors. Fewer rows than
ENTRIES give smaller codebooks. An empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import released, table
from tracelake.operators.joins import joined
from tracelake.shared import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096

#: Rows and components under one tree at most, rows of a leaf on average at least, bits of a component.
BLOCK, COMPONENTS, LEAF, SIZE = 8192, 2**20, 16, 28

TREES = "vec_ids array<long>, labels array<int>, n int, " + ", ".join(f"{x} array<binary>" for x in ("points", "places", "low", "high", "sums"))


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)


def integers(vectors: np.ndarray) -> np.ndarray:
    out = np.floor(vectors.astype(np.float64) * SCALE)
    if out.size and np.abs(out).max() >= 2**SIZE:
        raise ValueError(f"a component of 2^{SIZE} / {SCALE} or more")
    return out.astype(np.int64)


def starts(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin among n rows."""
    return (np.arange(2**level, dtype=np.int64) * n) >> level


def levels(n: int) -> int:
    """Levels under the root of a tree over n rows."""
    return max(0, (n // LEAF).bit_length() - 1)


def grown(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A kd-tree over rows: the points in the tree's order, their places in the
    block, and each node's lowest and highest components and sum, level by level.
    The nodes of a level are consecutive rows, halved where they are widest."""
    n, places = len(points), np.arange(len(points))
    low, high, sums = [], [], []
    for level in range(levels(n) + 1):
        first = starts(n, level)
        if level:
            before = starts(n, level - 1)
            node = np.repeat(np.arange(len(before)), np.diff(np.append(before, n)))
            widest = (high[-1] - low[-1]).argmax(1)
            order = np.lexsort((points[np.arange(n), widest[node]], node))
            points, places = points[order], places[order]
        low.append(np.minimum.reduceat(points, first))
        high.append(np.maximum.reduceat(points, first))
        sums.append(np.add.reduceat(points, first))
    return points, places, np.concatenate(low), np.concatenate(high), np.concatenate(sums)


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((points[:, None] - entries[None]) ** 2).sum(2)


def kept_entries(low: np.ndarray, high: np.ndarray, entries: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which of the held entries may be the nearest one somewhere in each box."""
    none = np.iinfo(np.int64).max
    middle = np.where(held, squared(low + high, 2 * entries), none).argmin(1)  # the entry nearest to the box's middle
    best = entries[middle]
    apart = entries[None] - best[:, None]
    # |p - entry|^2 - |p - best|^2 is linear in p: least where each component goes the entry's way
    least = (entries**2).sum(1)[None] - (best**2).sum(1)[:, None] - 2 * np.where(apart > 0, high[:, None] * apart, low[:, None] * apart).sum(2)
    return held & ((least < 0) | (least == 0) & (np.arange(len(entries))[None] <= middle[:, None]))


def filtered(n: int, points: np.ndarray, low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> Iterator[tuple]:
    """Down the tree: of each level (level, the nodes with one entry left, the entry),
    and of leaves with several left (None, their rows, the entry of each)."""
    depth, nodes, held = levels(n), np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    for level in range(depth + 1):
        at = 2**level - 1 + nodes
        held = kept_entries(low[at], high[at], entries, held)
        one = held.sum(1) == 1
        yield level, nodes[one], held[one].argmax(1)
        nodes, held = nodes[~one], held[~one]
        if level < depth:
            nodes, held = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel(), np.repeat(held, 2, 0)
    if len(nodes):
        edges = np.append(starts(n, depth), n)
        rows = np.concatenate([np.arange(edges[k], edges[k + 1]) for k in nodes])
        far = np.where(np.repeat(held, edges[nodes + 1] - edges[nodes], 0), squared(points[rows], entries), np.iinfo(np.int64).max)
        yield None, rows, far.argmin(1)


class Block:
    """A block's trees as a row of the written table has them."""

    def __init__(self, row: dict) -> None:
        self.n, self.row = row["n"], row

    def part(self, name: str, part: int, dtype=np.int32) -> np.ndarray:
        got = np.frombuffer(self.row[name][part], dtype).astype(np.int64)
        return got if name == "places" else got.reshape(-1, len(got) // (self.n if name == "points" else 2 ** (levels(self.n) + 1) - 1))

    def gathered(self, part: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and number of the rows of each entry."""
        points, low, high = (self.part(x, part) for x in ("points", "low", "high"))
        sums = self.part("sums", part, np.int64)
        total, count = np.zeros_like(entries), np.zeros(len(entries), np.int64)
        for level, at, entry in filtered(self.n, points, low, high, entries):
            if level is None:
                np.add.at(total, entry, points[at])
                np.add.at(count, entry, 1)
            else:
                np.add.at(total, entry, sums[2**level - 1 + at])
                np.add.at(count, entry, np.diff(np.append(starts(self.n, level), self.n))[at])
        return total, count

    def assigned(self, part: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each row, in the block's order."""
        points, low, high = (self.part(x, part) for x in ("points", "low", "high"))
        entry_of = np.zeros(self.n, np.int64)
        for level, at, entry in filtered(self.n, points, low, high, entries):
            if level is None:
                entry_of[at] = entry
            else:
                edges = np.append(starts(self.n, level), self.n)
                for k, e in zip(at, entry, strict=True):
                    entry_of[edges[k] : edges[k + 1]] = e
        codes, error = np.empty(self.n, np.int64), np.empty(self.n, np.int64)
        places = self.part("places", part)
        codes[places], error[places] = entry_of, ((points - entries[entry_of]) ** 2).sum(1)
        return codes, error


def trees(df: DataFrame, length: int) -> DataFrame:
    """Blocks of BLOCK rows of (vec_id, label, vector), each with a tree over each part."""
    width, size = length // PARTS, max(LEAF, min(BLOCK, COMPONENTS // length))

    def block(rows: pa.Table) -> pa.RecordBatch:
        vectors = integers(np.asarray(rows["vector"].combine_chunks().flatten()).reshape(-1, length))
        made = [grown(vectors[:, k * width : (k + 1) * width]) for k in range(PARTS)]
        kinds = (np.int32, np.int32, np.int32, np.int32, np.int64)
        arrays = [[[m[k].astype(kind).tobytes() for m in made]] for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([
            pa.array([rows["vec_id"].to_pylist()], pa.list_(pa.int64())), pa.array([rows["label"].to_pylist()], pa.list_(pa.int32())), pa.array([len(vectors)], pa.int32()),
            *[pa.array(a, pa.list_(pa.binary())) for a in arrays],
        ], ["vec_ids", "labels", "n", "points", "places", "low", "high", "sums"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - sum(b.num_rows for b in held))
                held.append(part)
                batch = batch.slice(part.num_rows)
                if sum(b.num_rows for b in held) == size:
                    yield block(pa.Table.from_batches(held))
                    held = []
        if held:
            yield block(pa.Table.from_batches(held))

    return df.mapInArrow(built, TREES)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    released()
    for batch in batches:
        for k in range(batch.num_rows):
            yield Block(batch.slice(k, 1).to_pylist()[0])


def updated(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each entry the floor of its rows' mean; unused ones stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for block in _blocks(batches):
            for part, entries in enumerate(books):
                t, c = block.gathered(part, entries)
                total[part] += t
                count[part] += c
        part, entry = (x.ravel() for x in np.indices(count.shape))
        used = count.ravel() > 0
        columns = [part[used].astype(np.int32), entry[used].astype(np.int32), count.ravel()[used]]
        rows = pa.FixedSizeListArray.from_arrays(pa.array(total.reshape(-1)), books.shape[2]).cast(pa.list_(pa.int64())).filter(pa.array(used))
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), rows], ["part", "entry", "n", "total"])

    got = blocks.select("n", "points", "low", "high", "sums").mapInArrow(sums, "part int, entry int, n long, total array<long>")
    got = got.select("part", "entry", "n", F.posexplode("total").alias("pos", "x")).groupBy("part", "entry", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    out = books.copy()
    for r in got.collect():
        out[r["part"], r["entry"], r["pos"]] = r["x"] // r["n"]
    return out


def coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of every row."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            code, error = zip(*[block.assigned(part, entries) for part, entries in enumerate(books)], strict=True)
            text = [bytes(row).hex() for row in np.stack(code, 1).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.row["vec_ids"], pa.int64()), pa.array(block.row["labels"], pa.int32()), pa.array(text), pa.array(np.sum(error, 0))], ["vec_id", "label", "code", "error"]
            )

    return blocks.select("vec_ids", "labels", "n", "points", "places", "low", "high").mapInArrow(codes, "vec_id long, label int, code string, error long")


def spelled(books: np.ndarray) -> str:
    return ",".join(str(x) for x in books.ravel().tolist())


def compressed(df: DataFrame, ident: str, vector: str, label: Column) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code and error of every usable row, and the codebooks (part, entry, component)."""
    rows = usable(df, vector).select(F.col(ident).cast("long").alias("vec_id"), label.alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).collect()
    length = len(first[0]["vector"]) if first else PARTS
    if length % PARTS:
        raise ValueError(f"{PARTS} equal parts of {length} components")
    rows = rows.where(F.size("vector") == length)
    if len({len(r["vector"]) for r in first}) > 1:
        first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).collect()
    books = integers(np.array([r["vector"] for r in first]).reshape(len(first), PARTS, length // PARTS)).transpose(1, 0, 2).copy()
    blocks = written(trees(rows, length), "lloyd-trees")
    for _ in range(ROUNDS if first else 0):
        books = updated(blocks, books)
    return coded(blocks, books), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, their errors, and the errors of their label."""
    codes, books = compressed(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("label").cast("int"))
    rows = written(codes.withColumn("_label", F.coalesce(F.col("label").cast("string"), F.lit("-"))).drop("label"), "lloyd-codes")
    sums = rows.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    digest = hashlib.sha256(spelled(books).encode()).hexdigest()
    return joined(rows, sums, "_label", "_n").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
