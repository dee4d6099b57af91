"""SimHash near-duplicates: 64-bit fingerprints and their links by the general
pigeonhole principle.

1. A fingerprint per text from the XXH64 of its word shingles.
2. The distinct fingerprints only. Counts over all of them give each bit's rate
   and the correlations of bits; correlated bits go to one part.
3. If two fingerprints differ in at most `tau` bits and the parts' thresholds
   add up to tau - parts + 1, then in some part they differ in at most that
   part's threshold. A dynamic programme over the parts finds the thresholds
   with the least estimated cost of probes and candidates, for two to five
   parts; the cheapest plan is used.
4. Each fingerprint is filed under its value of every part and probes the
   values within the threshold. Where many meet under one value, the rows are
   dealt into blocks and each pair of blocks is a unit of work of its own.
5. A unit compares all its pairs exactly, and keeps one link per row and
   cluster, enough for the components; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import released, table
from tracelake.operators.components import components
from tracelake.operators.joins import joined
from tracelake.shared import written

BITS = 64
#: Rows of one block; a unit of work holds two blocks on average at most.
BLOCK = 192
#: Cost of one compared pair against one probe row that is shuffled and sorted.
PAIR_COST = 0.004
_SLICE = 1 << 15


def fingerprint(text: str | None, words_per_shingle: int = 4) -> int:
    """Unsigned fingerprint of a text; zero without words (or without a text)."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    k = min(words_per_shingle, len(words))
    last = (ends[k - 1 :] - 1).tolist()
    counts, n, hashed = np.zeros(BITS, np.int64), len(last), xxhash.xxh64_intdigest
    for at in range(0, n, _SLICE):
        some = [hashed(joined[a:b], 42) for a, b in zip(starts[at : at + _SLICE], last[at : at + _SLICE], strict=False)]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, BITS).sum(0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 4) -> DataFrame:
    """(doc_id, fp): one row per row of `docs`; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words_per_shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def fingerprint_column(words_per_shingle: int = 4):
    """A function from a text column to its fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        released()
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, words_per_shingle) for t in texts], np.uint64).view(np.int64))

    return of


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and how often each two bits are both set (64 by 64), over all rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros((BITS, BITS))
        for f in frames:
            bits = _bits(f["fp"].to_numpy()).astype(np.float32)
            n, total = n + len(bits), total + bits.T @ bits
        if n:
            yield pd.DataFrame({"cell": np.arange(BITS * BITS + 1), "n": np.append(total.ravel(), n)})

    rows = fps.select("fp").mapInPandas(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1)
    for r in rows:
        cells[r["cell"]] = r["n"]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of nearly equal size; a part starts from the free bit that is most
    correlated with the other free bits and takes those closest to what it has."""
    rate = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(rate, rate)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        want = (BITS * (k + 1)) // parts - (BITS * k) // parts
        part = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(part[0])
        while len(part) < want:
            nearest = max(free, key=lambda b: (corr[b, part].sum(), -b))
            part.append(nearest)
            free.remove(nearest)
        out.append(sorted(part))
    return out


def _within(n: int, both: np.ndarray, part: list[int], most: int) -> list[float]:
    """Estimated pairs of rows that differ in at most 0, 1, .. most bits of the
    part: bits taken as independent, with the number of bits reduced by what
    their correlation makes redundant."""
    rate = np.diag(both)[part] / max(n, 1)
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
    corr = (both[np.ix_(part, part)] / max(n, 1) - np.outer(rate, rate)) / np.outer(spread, spread)
    share = len(part) / max(1.0, float((np.clip(corr, -1, 1) ** 2).sum()))  # effective bits over bits
    chance = np.zeros(most + 1)
    chance[0] = 1.0
    for p in 2 * rate * (1 - rate) * min(1.0, share):
        chance[1:] = chance[1:] * (1 - p) + chance[:-1] * p
        chance[0] *= 1 - p
    return (np.cumsum(chance) * n * n / 2).tolist()


def _values_within(width: int, most: int) -> int:
    return sum(len(list(combinations(range(width), r))) for r in range(most + 1)) if most >= 0 else 0


def plan(n: int, both: np.ndarray, tau: int) -> list[tuple[list[int], int]]:
    """Parts of bits, each with its threshold (-1: the part isn't needed)."""
    best: tuple[float, list] | None = None
    for parts in range(2, 6):
        groups, budget = grouped_bits(n, both, parts), tau - parts + 1
        # least[s]: cost and thresholds of the parts so far whose thresholds add up to s
        least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            pairs = _within(n, both, g, tau)
            after: dict[int, tuple[float, list[int]]] = {}
            for s, (cost, chosen) in least.items():
                for t in range(-1, min(tau, 2) + 1):
                    own = 0.0 if t < 0 else n * (1 + _values_within(len(g), t) / 2) + PAIR_COST * pairs[t]
                    if s + t not in after or cost + own < after[s + t][0]:
                        after[s + t] = (cost + own, [*chosen, t])
            least = after
        if budget in least and (best is None or least[budget][0] < best[0]):
            best = (least[budget][0], list(zip(groups, least[budget][1], strict=True)))
    return best[1]


def _probes(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, fp, kind): kind 0 files a row under its own value, kind 1
    looks it up under a larger value within the threshold. Of two values within
    the threshold the smaller one's row probes the larger one's, so each pair
    of different values meets once and equal values meet as filed."""
    flips = []
    for bits, t in parts:
        masks = [sum(1 << i for i in c) for r in range(1, t + 1) for c in combinations(range(len(bits)), r)]
        flips.append(np.array(masks, np.int64))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = f["fp"].to_numpy()
            for at in range(0, len(fp), 4096):
                some, rows = fp[at : at + 4096], []
                bits = _bits(some).astype(np.int64)
                for k, (part, t) in enumerate(parts):
                    if t < 0:
                        continue
                    value = bits[:, part] @ (np.int64(1) << np.arange(len(part)))
                    rows.append((k, value, some, 0))
                    if len(flips[k]):
                        other = value[:, None] ^ flips[k][None, :]
                        i, j = np.nonzero(other > value[:, None])
                        rows.append((k, other[i, j], some[i], 1))
                yield pd.DataFrame(
                    {
                        "part": np.concatenate([np.full(len(v), k, np.int32) for k, v, _, _ in rows]),
                        "key": np.concatenate([v for _, v, _, _ in rows]),
                        "fp": np.concatenate([s for _, _, s, _ in rows]),
                        "kind": np.concatenate([np.full(len(v), d, np.int32) for _, v, _, d in rows]),
                    }
                )

    return fps.select("fp").mapInPandas(run, "part int, key long, fp long, kind int")


def _unit_links(fp: np.ndarray, kind: np.ndarray, block: np.ndarray, bi: int, bj: int, tau: int) -> tuple | None:
    """Links of one unit, one for each row that has a smaller relative in it."""
    filed = np.flatnonzero(kind == 0)
    if not len(filed) or len(fp) < 2:
        return None
    near = np.bitwise_count((fp[:, None] ^ fp[filed][None, :]).view(np.uint64)) <= tau
    near &= fp[:, None] != fp[filed][None, :]
    if bi != bj:
        near &= block[:, None] != block[filed][None, :]
    rows, cols = np.nonzero(near)
    if not len(rows):
        return None
    a, b = fp[rows], fp[filed][cols]
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:  # smallest label of the neighbours, until nothing changes
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            break
        low = new
    other = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[other], nodes[low[other]]


def links(fps: DataFrame, tau: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints at `tau` or fewer differing
    bits, as many as their components need. `fps` holds distinct values."""
    spark = fps.sparkSession
    n, both = bit_counts(fps)
    if n < 2:
        return spark.createDataFrame([], "a long, b long")
    parts = plan(n, both, tau)
    probes = _probes(fps, parts)
    # A value under which more rows meet than a block holds is dealt into blocks.
    many = (
        probes.groupBy("part", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    )
    placed = probes.join(many.drop("n"), ["part", "key"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    paired = placed.select(
        "part", "key", "fp", "kind", "block",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    ).select(
        "part", "key", "fp", "kind", "block",
        F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"),
    )
    unit = ["part", "key", "bi", "bj"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        released()
        held: pd.DataFrame | None = None

        def done(f: pd.DataFrame) -> pd.DataFrame:
            """All units of `f`, whose rows are in order of the unit."""
            key = f[unit].to_numpy()
            edges = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            fp, kind, block = f["fp"].to_numpy(), f["kind"].to_numpy(), f["block"].to_numpy()
            out = []
            for s, e in zip([0, *edges], [*edges, len(f)], strict=True):
                if e - s > 1 and (found := _unit_links(fp[s:e], kind[s:e], block[s:e], key[s, 2], key[s, 3], tau)):
                    out.append(found)
            a = np.concatenate([x[0] for x in out]) if out else np.array([], np.int64)
            b = np.concatenate([x[1] for x in out]) if out else np.array([], np.int64)
            return pd.DataFrame({"a": a, "b": b})

        for f in frames:
            if not len(f):
                continue
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            last = (f[unit] == f[unit].iloc[-1]).all(axis=1).to_numpy()
            cut = len(f) - int(np.argmin(last[::-1])) if not last.all() else 0
            if cut:
                yield done(f.iloc[:cut])
            held = f.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield done(held)

    return paired.repartition(*unit).sortWithinPartitions(*unit).mapInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words_per_shingle: int = 4, tau: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of `docs`.

    fingerprint: 16 lower-case hex digits. component_id: the smallest doc_id
    whose fingerprint can be reached over links of at most `tau` differing bits.
    A null text counts as an empty one: fingerprint zero, linked like any other.
    Repeated rows and repeated ids are each a row of the result. A row with a
    null doc_id is kept and gives no component its id; where all ids of a
    component are null, so is its id. Other columns of `docs` play no part. An
    empty table gives an empty result.
    """
    of_docs = written(fingerprints(docs, words_per_shingle), "fingerprints")
    return joined(of_docs, _component_of(of_docs, tau), "fp", "n").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def _component_of(of_docs: DataFrame, tau: int) -> DataFrame:
    """(fp, component_id, root, n) of each fingerprint among (doc_id, fp); root is
    a number for its component, n the rows that have the fingerprint."""
    distinct = written(of_docs.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = components(links(distinct.select("fp"), tau))
    named = distinct.join(roots, distinct["fp"] == roots["vertex"], "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    named = written(named, "named")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("fps"))
    return written(joined(named, lowest, "root", "fps").select("fp", "component_id", "root", "n"), "components")


def kept_documents(docs: DataFrame, words_per_shingle: int = 4, tau: int = 4) -> DataFrame:
    """One row of each component, with all columns of `docs`: that with the
    smallest doc_id, a null one only where the component has no other; among
    rows that share the id the smallest fingerprint, then the smallest text."""
    of_text = fingerprint_column(words_per_shingle)(F.col("text").cast("string"))
    # Each text is fingerprinted once; only ids and fingerprints go through the search.
    marked = written(docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_fp": of_text}), "marked")
    of_docs = marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_fp").alias("fp"))
    found = joined(of_docs, _component_of(of_docs, tau), "fp", "n")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), F.col("fp").alias("_fp"))
    keep = found.groupBy("root").agg(F.min(first).alias("row")).select("row._id", "row._fp")
    one = F.row_number().over(Window.partitionBy("_id", "_fp").orderBy("text"))
    rows = marked.join(keep, ["_id", "_fp"], "left_semi")
    return rows.withColumn("_n", one).where("_n = 1").select(docs.columns)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
