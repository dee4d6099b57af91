"""Vector codes, Merkle manifest and shards against plain versions, on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import filtering_lloyd, merkle, sharding

VECTORS = "vec_id long, embedding array<float>, label int, code string, error string"


def lloyd(rows):
    """Every entry against every part of (vec_id, integers, label)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    parts = np.stack([r[1] for r in rows]).reshape(len(rows), 8, -1)
    books = parts[:16].transpose(1, 0, 2).copy()
    for turn in range(7):
        far = ((parts[:, :, None] - books[None]) ** 2).sum(3)
        code = far.argmin(2)
        for p, e in np.ndindex(*books.shape[:2]) if turn < 6 else ():
            if len(own := parts[code[:, p] == e, p]):
                books[p, e] = [int(x) // len(own) for x in own.sum(0)]
    error = far.min(2).sum(1)
    label = {x: int(sum(e for r, e in zip(rows, error, strict=True) if r[2] == x)) for x in {r[2] for r in rows}}
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    return [(r[0], bytes(c.tolist()).hex(), int(e), label[r[2]], digest) for r, c, e in zip(rows, code, error, strict=True)]


def written(tmp_path, df, name):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("block", [8192, 50])
def test_vector_codes_of_odd_rows(spark, tmp_path, monkeypatch, block):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(filtering_lloyd, "BLOCK", block)
    centres = rng.normal(size=(6, 16))
    rows = [(k, (centres[k % 6] + rng.normal(size=16) * (k % 3) / 8).astype("f4").tolist(), k % 4 or None, None, "x") for k in range(400)]
    rows += [(1000 + k, rows[7][1], 2, "c", None) for k in range(200)]  # a third alike
    rows += [(5, rows[9][1], 3, None, None), (5, rows[9][1], 3, None, None), (None, rows[11][1], 1, None, None), (2000, [0.0] * 16, 1, None, None)]
    odd = [(3000, None, 1, None, None), (3001, [None] * 16, 1, None, None), (3002, [float("nan")] * 16, 1, None, None), (3003, [float("inf")] + [0.0] * 15, 1, None, None), (3004, [], 1, None, None), (3005, [1.0] * 8, 1, None, None)]
    d = written(tmp_path, spark.createDataFrame(rows + odd, VECTORS).repartition(3), "embeddings")
    got = sorted(map(tuple, filtering_lloyd.op11_vector_codes(spark, d).collect()), key=repr)
    want = lloyd([(i, np.floor(np.array(v) * 4096).astype(int), label) for i, v, label, *_ in rows])
    assert got == sorted(want, key=repr)


def test_vector_codes_of_few_and_no_rows(spark, tmp_path):
    few = [(k, [float(k)] * 8, None, None, None) for k in range(3)]
    for name, rows, want in (("a", few, lloyd([(i, np.floor(np.array(v) * 4096).astype(int), None) for i, v, *_ in few])), ("b", [], [])):
        d = written(tmp_path / name, spark.createDataFrame(rows, VECTORS), "embeddings")
        assert sorted(map(tuple, filtering_lloyd.op11_vector_codes(spark, d).collect())) == want
    with pytest.raises(ValueError, match="equal parts"):
        filtering_lloyd.compressed(spark.createDataFrame([(1, [1.0] * 9, 1, None, None)], VECTORS), "vec_id", "embedding", F.col("label"))
    with pytest.raises(ValueError, match="a component of"):
        filtering_lloyd.integers(np.array([1e9]))


def test_whole_subtrees_are_assigned():
    """In two tight clusters, nodes keep one entry far above the leaves, and few rows are looked at."""
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.integers(0, 9, (4000, 4)), rng.integers(1000, 1009, (4000, 4))])
    entries = np.array([[4, 4, 4, 4], [1004, 1004, 1004, 1004], [9999, 0, 0, 0]])
    tree = filtering_lloyd.grown(points)
    steps = list(filtering_lloyd.filtered(len(points), tree[0], tree[2], tree[3], entries))
    assert [level for level, nodes, _ in steps if len(nodes)] == [1]


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][k : k + 2])) for k in range(0, len(out[-1]), 2)])
    return out


def way(tree, k):
    """(sibling, slot of one's own) of each level."""
    for nodes in tree[:-1]:
        yield nodes[k ^ 1] if k ^ 1 < len(nodes) else "", k & 1
        k //= 2


def manifest(rows):
    """Of (doc_id, source, lang, n_chars, text): the rows of the manifest, node by node."""
    trees, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        trees[x] = levels([leaf(r) for r in order if r[2] == x])
    top = levels([trees[x][-1][0] for x in langs])
    for g, x in enumerate(langs):
        for k, r in enumerate(r for r in order if r[2] == x):
            steps = [*way(trees[x], k), *way(top, g)]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            h = leaf((*r[:3], r[3] + 1, r[4])) if bad else leaf(r)
            for other, slot in steps:
                h = H(other + h if slot else h + other)
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], H("".join(s for s, _ in steps)), h, h == top[-1][0]))
    return out


def test_manifest_of_odd_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, "web", "ü"]), "en" if k < 150 else rng.choice([None, "de", "中", ""]), rng.choice([None, k, 2**63 - 1]), rng.choice([None, "", "x" * k, "wörter " * 5])) for k in range(200)]
    rows += [(None, None, "only", None, None), (7, "web", "en", 3, "again"), (7, "web", "en", 3, "again"), (None, "a", "en", 1, "b"), (None, "a", "en", 1, "b"), (500, "w", None, 5, "long " * 50_000)]
    for name, some in (("many", rows), ("one", rows[:1]), ("group", rows[:33]), ("none", [])):
        docs = spark.createDataFrame([(*r, "x", 1) for r in some], "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos int")
        got = sorted(map(tuple, merkle.op12_merkle(spark, written(tmp_path / name, docs, "documents")).collect()), key=repr)
        assert got == sorted(manifest(some) if some else [], key=repr), name


def test_a_stored_path_shows_any_change(spark):
    rows = spark.range(70).select(F.lit("g").alias("grp"), "id", F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    got = merkle.manifest(rows).withColumn("same", merkle.folded(F.col("hash"), F.col("path")) == F.col("root"))
    got = got.withColumn("other", merkle.folded(F.sha2(F.lit("z"), 256), F.col("path")) == F.col("root")).collect()
    assert len(got) == 70 and all(r["same"] and not r["other"] and len(r["path"]) == 7 for r in got)


def shards_of(rows, shards):
    """Exact edges of (doc_id, text), row by row."""
    data = sorted((hashlib.md5((t or "").encode()).hexdigest(), i is not None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    total, at, own, first, out, slots = sum(r[3] for r in data), 0, {}, {}, [], {}
    for key, *_, size, _ in data:
        first.setdefault(key, at)
        own[key] = own.get(key, 0) + size
        at += size
    at = 0
    for key, known, i, size, crc in data:
        small = own[key] * sharding.KEEP * shards <= total
        shard = ((2 * first[key] + own[key]) if small else (2 * at + size)) * shards // (2 * total)
        slots[shard] = slots.get(shard, -1) + 1
        out.append((i if known else None, size, crc, shard, slots[shard]))
        at += size
    return out


@pytest.mark.parametrize(("rows_of_range", "sampled"), [(2_000_000, 32), (50, 32), (50, 1)])
def test_shards_with_a_hot_text(spark, monkeypatch, rows_of_range, sampled):
    rng = random.Random(1)
    monkeypatch.setattr(sharding, "SAMPLED", sampled)
    rows = [(k, "the same text" if k % 3 == 0 else " ".join(rng.choices("abcdefg", k=rng.randint(0, 60)))) for k in range(4000)]
    rows += [(9000, "long " * 20_000), (9001, None), (9002, "")] + [(None, "no id")] * 50 + [(9003, "again")] * 50
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, key string, shard int")
    got = sorted(map(tuple, sharding.sharded(docs, 40, rows_of_range).collect()), key=repr)
    assert got == sorted(shards_of(rows, 40), key=repr)


def test_shards_are_near_equal_and_of_no_rows_none(spark, tmp_path):
    rows = [(k, "w" * (k % 100)) for k in range(5000)]
    sizes = [r["b"] for r in sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 40 and max(sizes) < 1.1 * sum(sizes) / 40 and min(sizes) > 0.9 * sum(sizes) / 40
    d = written(tmp_path, spark.createDataFrame([], "doc_id long, text string"), "documents")
    assert sharding.op13_shards(spark, d).collect() == []


def test_shards_run_without_python_workers(spark, tmp_path):
    d = written(tmp_path, spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), "documents")
    plan = sharding.op13_shards(spark, d)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))
