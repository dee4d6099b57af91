"""Approximate nearest neighbours over shifted space-filling curves.

Vectors are turned by several random rotations and projected on groups of a few
of the new axes. Each group of each rotation has a Hilbert curve. A vector is
filed on one curve of each rotation: that of the group that holds the largest
share of its length, where its projection tells most of it. A query looks on the
curves of the groups that hold the largest shares of its own length, among the
rows whose keys come next before and after its own.

Spark deals the entries out by range of curve and key; each task goes through
its range once and, for each query's window, ranks the rows by compact codes of
their vectors. The windows' finds are merged, and the best of them are ranked by
their exact distance. So a query looks at a number of entries that grows with
the root of the number of rows, and vectors are not copied.

Equal vectors are one class, searched once, with the few smallest ids that any
answer can hold; so a vector that many rows share makes no large range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import one_thread, table
from tracelake.shared import written

#: Rotations, axes of a group, axes that are grouped at most, bits of an axis in a key.
TURNS, AXES, MOST_AXES, BITS = 16, 4, 64, 10
#: Groups of each rotation that a query looks at.
PROBES = 8
#: Rows before and after a query's key that it looks at: this times the root of the rows, and so many at least.
WINDOW_SHARE, WINDOW_LEAST = 0.32, 32
#: Finds that are ranked by their exact distance, as a multiple of k + 1.
RERANK = 4
#: Windows that the rows of a range hold at least, so that few windows reach over a range's end.
RANGE_WINDOWS = 64
SEED = 11


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of rows of cell coordinates (0 to 2**bits - 1),
    by turning the coordinates into the transposed index bit plane by bit plane."""
    x = cells.astype(np.int64).copy()
    n, dims = x.shape
    for level in range(bits - 1, 0, -1):
        top, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            inside = (x[:, i] & top) != 0
            swap = np.where(inside, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(inside, low, swap)
            x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, -1] >> level) & 1, (1 << level) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> level) & 1)
    return key


class Curves:
    """Rotations, and the middle and spread of the rows on their axes."""

    def __init__(self, size: int, turns: int = TURNS):
        rng, dims = np.random.default_rng(SEED), min(size, MOST_AXES)
        self.turns, self.axes = turns, min(AXES, dims)
        self.groups = dims // self.axes
        dims = self.groups * self.axes
        self.turn = np.concatenate([np.linalg.qr(rng.standard_normal((size, size)))[0][:, :dims] for _ in range(turns)], axis=1)
        self.middle, self.spread = np.zeros(turns * dims), np.ones(turns * dims)
        #: up to half a cell either way
        self.shift = rng.uniform(-0.5, 0.5, turns * dims) / (1 << BITS)

    @property
    def key_bits(self) -> int:
        """Bits of a place along a curve, and the lowest one, set for queries."""
        return self.axes * BITS + 1

    def fit(self, n: float, sums: np.ndarray, squares: np.ndarray) -> None:
        self.middle = sums / max(n, 1)
        self.spread = np.sqrt(np.maximum(squares / max(n, 1) - self.middle**2, 0))
        self.spread[self.spread <= 1e-12 * np.abs(self.middle) + 1e-300] = 1.0

    def keys(self, x: np.ndarray, probes: int) -> np.ndarray:
        """(rows, rotations, probes): places on the curves of the groups with the largest shares."""
        place = ((x @ self.turn - self.middle) / self.spread).reshape(len(x), self.turns, self.groups, self.axes)
        share = (place * place).sum(-1)
        group = np.argsort(-share, axis=-1, kind="stable")[:, :, :probes]
        shift = np.broadcast_to(self.shift.reshape(1, self.turns, self.groups, self.axes), place.shape)
        some = np.take_along_axis(place, group[..., None], 2) / 8 + 0.5 + np.take_along_axis(shift, group[..., None], 2)  # 4 spreads to either side
        cells = np.clip((some * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
        curve = np.arange(self.turns)[None, :, None] * self.groups + group
        return (curve << self.key_bits) | (hilbert_key(cells.reshape(-1, self.axes), BITS) << 1).reshape(group.shape)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _rows_of(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def codes_of(x: np.ndarray) -> np.ndarray:
    """A scale and a byte for each component, as rows of bytes."""
    scale = (np.abs(x).max(1) / 127).astype(np.float32)
    steps = np.rint(x / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
    return np.concatenate([scale[:, None].view(np.uint8), steps.view(np.uint8)], axis=1)


def decoded(codes: np.ndarray) -> np.ndarray:
    return codes[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(codes[:, :4]).view(np.float32)


def _binary(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _codes(column: pa.BinaryArray) -> np.ndarray:
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)


def _usable(vectors: DataFrame, query_step: int) -> DataFrame:
    """(vec_id, v, h1, h2, asks) of the usable rows; h1 and h2 are the same for equal vectors."""
    v = F.col("embedding")
    usable = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
        .where(F.forall("v", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))) & F.exists("v", lambda c: c != 0))
    )
    same = F.transform("v", lambda c: c.cast("double") + F.lit(0.0))  # 0.0 and -0.0 are equal components
    return usable.select("vec_id", "v", F.xxhash64(same).alias("h1"), F.xxhash64(F.lit(SEED), same).alias("h2"), (F.pmod("vec_id", F.lit(query_step)) == 0).alias("asks"))


def vector_classes(vectors: DataFrame, k: int, query_step: int) -> DataFrame:
    """(cid, v, h1, h2, ids, asks): distinct usable vectors (by 128 bits of
    hashes), their smallest id, their k + 1 smallest ids, and whether one of
    their rows is a query. Unusable: null, zero, with null or non-finite
    components."""
    usable = _usable(vectors, query_step)
    first = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = usable.select("h1", "h2", "vec_id").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    ids = few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    one = usable.groupBy("h1", "h2").agg(F.min_by("v", "vec_id").alias("v"), F.max("asks").alias("asks"))
    return ids.join(one, ["h1", "h2"]).select(F.col("ids")[0].alias("cid"), "v", "h1", "h2", "ids", "asks")


def _fitted(classes: DataFrame, size: int, turns: int) -> tuple[int, np.ndarray, Curves]:
    """Rows, their mean, and the curves fitted to all of them."""
    curves = Curves(size, turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        one_thread()
        total = np.zeros(1 + size + 2 * curves.turn.shape[1])
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                x = _rows_of(batch.column(0).slice(at, 1024))
                y = x @ curves.turn
                total += np.concatenate([[len(x)], x.sum(0), y.sum(0), (y * y).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["cell", "s"])

    total = np.zeros(1 + size + 2 * curves.turn.shape[1])
    for r in classes.select("v").mapInArrow(run, "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect():
        total[r["cell"]] = r["s"]
    n, (sums, squares) = total[0], total[1 + size :].reshape(2, -1)
    curves.fit(n, sums, squares)
    return int(n), total[1 : 1 + size] / max(n, 1), curves


def _entries(classes: DataFrame, curves: Curves, mean: np.ndarray, probes: int) -> DataFrame:
    """(key, cid, code): each class on a curve of each rotation; a query besides as such on each curve it looks at."""
    shared = classes.sparkSession.sparkContext.broadcast((curves, mean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        curves, mean = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cid, asks, x = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False).astype(bool), _rows_of(part.column(2))
                code, row, who = codes_of(x - mean), np.arange(len(x)), np.flatnonzero(asks)
                key = [curves.keys(x, 1).ravel(), curves.keys(x[who], probes).ravel() | 1]
                row = np.concatenate([np.repeat(row, curves.turns), np.repeat(who, curves.turns * probes)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), pa.array(cid[row]), _binary(code[row])], ["key", "cid", "code"])

    return classes.select("cid", "asks", "v").mapInArrow(run, "key long, cid long, code binary")


def _windows(entries: DataFrame, curve_bits: int, window: int, most: int) -> DataFrame:
    """(qid, near): for each query's entry the `most` nearest by code among the
    `window` rows before and after it on its curve, in a task's range of ordered entries."""

    def found(key: np.ndarray, cid: np.ndarray, code: np.ndarray, rows: np.ndarray, asks: np.ndarray, before: np.ndarray) -> pa.RecordBatch:
        x, q, curve = decoded(code[rows]), decoded(code[asks]), key >> curve_bits
        count, score, who = [], [], []
        step = max(1, (1 << 20) // (2 * window * x.shape[1]))
        for s in range(0, len(asks), step):
            at = before[s : s + step, None] + np.arange(-window, window)
            at, there = np.clip(at, 0, len(rows) - 1), (at >= 0) & (at < len(rows))
            ask = asks[s : s + step, None]
            there &= (curve[rows[at]] == curve[ask]) & (cid[rows[at]] != cid[ask])
            gap = x[at] - q[s : s + step, None, :]
            d = np.where(there, np.einsum("qwd,qwd->qw", gap, gap), np.inf)
            best = np.argpartition(d, min(most, d.shape[1] - 1), axis=1)[:, :most]
            d = np.take_along_axis(d, best, 1)
            good = np.isfinite(d)
            count.append(good.sum(1))
            score.append(d[good])
            who.append(cid[rows[np.take_along_axis(at, best, 1)]][good])
        ends = np.cumsum(np.concatenate([[0], *count])).astype(np.int32)
        near = pa.StructArray.from_arrays([pa.array(np.concatenate(score), pa.float32()), pa.array(np.concatenate(who), pa.int64())], ["score", "cid"])
        return pa.RecordBatch.from_arrays([pa.array(cid[asks]), pa.ListArray.from_arrays(pa.array(ends), near)], ["qid", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def taken(last: bool) -> Iterator[pa.RecordBatch]:
            """Answers the queries whose window is complete; the others stay, with the rows that they or later ones look at."""
            nonlocal held
            key, cid, code = held
            asks, rows = np.flatnonzero(key & 1), np.flatnonzero(~key & 1)
            before = np.searchsorted(rows, asks)
            ready = len(asks) if last else int(np.searchsorted(before, len(rows) - window, "right"))
            if ready and len(rows):
                yield found(key, cid, code, rows, asks[:ready], before[:ready])
            first = before[ready] if ready < len(asks) else len(rows)
            keep = np.sort(np.concatenate([rows[max(0, first - window) :], asks[ready:]]))
            held = key[keep], cid[keep], code[keep]

        for batch in batches:
            if batch.num_rows:
                new = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _codes(batch.column(2))
                held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
                if len(held[0]) >= 2 * window:
                    yield from taken(False)
        if held is not None:
            yield from taken(True)

    return entries.mapInArrow(run, "qid long, near array<struct<score:float,cid:long>>")


def window_of(n: int) -> int:
    return max(WINDOW_LEAST, int(np.ceil(WINDOW_SHARE * n**0.5)))


def nearest(vectors: DataFrame, k: int = 10, query_step: int = 100, turns: int = TURNS, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by
    `query_step` its k nearest found among all other rows, by Euclidean
    distance in double precision, ties to the smaller vec_id; all of them if
    there are fewer than k. Null ids and unusable vectors take no part, nor do
    vectors whose length isn't the most frequent one (of equally frequent ones
    the smallest). Rows that repeat an id with the same vector count once. Other
    columns play no part; an empty table gives an empty result. A window that
    reaches over the end of a task's range is cut there; a range holds many
    windows, and each query has one on many curves."""
    spark = vectors.sparkSession
    classes = written(vector_classes(vectors, k, query_step), "classes")
    lengths = classes.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = lengths[0]["n"]
    classes = classes.where(F.size("v") == size)
    n, mean, curves = _fitted(classes, size, turns)
    window, probes = window_of(n), min(probes, curves.groups)
    entries = _entries(classes, curves, mean, probes)
    ranges = min(int(spark.conf.get("spark.sql.shuffle.partitions")), n * turns // (RANGE_WINDOWS * window))
    ordered = entries.repartitionByRange(max(1, ranges), "key", "cid").sortWithinPartitions("key", "cid")
    near = _windows(ordered, curves.key_bits, window, k + 1).groupBy("qid").agg(F.flatten(F.collect_list("near")).alias("near"))
    best = F.slice(F.array_sort(F.array_distinct("near")), 1, RERANK * (k + 1))
    pairs = near.select("qid", F.explode(best).alias("x")).select("qid", F.col("x.cid").alias("cid"))
    itself = classes.where("asks").select(F.col("cid").alias("qid"), "cid", F.lit(0.0).alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("score", "cid"))
    top = _measured(pairs, classes).unionByName(itself).withColumn("n", rank).where(F.col("n") <= k + 2)
    # the classes' rows: at most k + 1 ids each, nearest first, then by id
    answers = (
        top.join(classes.select("cid", "ids"), "cid")
        .select("qid", F.explode(F.transform("ids", lambda i: F.struct(F.col("score").alias("score"), i.alias("vec_id")))).alias("x"))
        .groupBy("qid").agg(F.slice(F.sort_array(F.collect_list("x")), 1, k + 1).alias("found"))
    )
    asking = _usable(vectors, query_step).where("asks").select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct()
    asking = asking.join(classes.where("asks").select("h1", "h2", F.col("cid").alias("qid")), ["h1", "h2"])
    others: Column = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (
        asking.join(answers, "qid").select("query_id", F.posexplode(others).alias("rank", "x"))
        .select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
    )


def _measured(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(qid, cid, score): exact distances of pairs of classes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                gap = _matrix(f["q"]) - _matrix(f["v"])
                yield pd.DataFrame({"qid": f["qid"], "cid": f["cid"], "score": np.sqrt((gap * gap).sum(-1))})

    asking = classes.where("asks").select(F.col("cid").alias("qid"), F.col("v").alias("q"))
    return pairs.join(classes.select("cid", "v"), "cid").join(asking, "qid").mapInPandas(run, "qid long, cid long, score double")


def op7_hilbert_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
