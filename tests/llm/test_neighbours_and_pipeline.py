import numpy as np

from tracelake.llm import hilbert_ann


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
        key = hilbert_ann.hilbert_key(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def plain(ids, x, k=10):
    out = {}
    for q in sorted({i for i in ids if i % 100 == 0}):
        v = x[ids == q][0]
        d = np.sqrt(((x - v) ** 2).sum(1))
        d[ids == q] = np.inf
        o = np.lexsort((ids, d))[:k]
        out[int(q)] = [int(i) for i in ids[o]]
    return out


def test_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[500:900] = x[500]  # one vector that many rows share
    ids = np.arange(1500)
    rows = [(int(i), v.tolist(), "c") for i, v in zip(ids, x, strict=True)]
    rows += [(2000, None, "c"), (2100, [0.0] * 16, "c"), (2200, [float("nan")] * 16, "c"), (2300, [None] * 16, "c"), (None, x[0].tolist(), "c"), (5, x[5].tolist(), "c"), (2400, [1.0, 2.0], "c")]
    got = hilbert_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")).collect()
    want = plain(ids, x.astype(float))
    of = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        of.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["score"] == np.sqrt(((x[r["query_id"]].astype(float) - x[r["vec_id"]].astype(float)) ** 2).sum())
    assert of.keys() == want.keys() and all(len(v) == 10 for v in of.values())
    assert np.mean([len(set(of[q]) & set(want[q])) / 10 for q in of]) >= 0.9
    assert all(of[q] == want[q] for q in (500, 600, 700, 800))  # copies, ties to the smaller id


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    got = hilbert_ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], schema)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 2), (0, 2, 1)]
    assert hilbert_ann.nearest(spark.createDataFrame([], schema)).count() == 0
    assert hilbert_ann.nearest(spark.createDataFrame([(0, [1.0])], schema)).count() == 0


def test_recall_with_a_tight_cluster(spark):
    """64 axes without structure, and a third of the rows close together but distinct:
    most true neighbours are found among few of the rows."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((9000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[6000:] = x[6000] + 0.02 * rng.standard_normal((3000, 64))
    ids = np.arange(len(x))
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    of = {}
    for r in hilbert_ann.nearest(rows).orderBy("query_id", "rank").collect():
        of.setdefault(r["query_id"], []).append(r["vec_id"])
    want = plain(ids, x)
    assert of.keys() == want.keys() and np.mean([len(set(of[q]) & set(want[q])) / 10 for q in want]) >= 0.9
    assert 2 * hilbert_ann.window_of(50_000_000) * hilbert_ann.TURNS * hilbert_ann.PROBES < 0.02 * 50_000_000  # entries that a query meets


def test_pipeline_against_its_stages_one_by_one(spark, tmp_path, odd_docs):
    """Nulls, empty, very long and repeated texts, clashing columns: run() keeps what plain versions of its stages keep."""
    import corpus_pipeline
    from tests.llm.test_text_operators import ITEM, labelled
    from tracelake.llm import decontaminate, sentencepiece_tok, simhash, toxicity

    texts, labels = labelled(400)
    rows = [(100 + i, t, "en", 1, "a", "x", "y") for i, t in enumerate(texts)] + [(900, f"so {ITEM} then", None, None, None, None, None), (901, texts[1], "en", 2, "b", "x", "y")]
    odd_docs.unionByName(spark.createDataFrame(rows, odd_docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100 + i, y) for i, y in enumerate(labels)] + [(None, 1), (1, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.model_for(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scorer = toxicity._Scorer(model)
    every = docs.collect()
    left = [r for r, s in zip(every, scorer.m.probability(scorer.worst([r["text"] for r in every]).astype(float)), strict=True) if s < 0.5]
    prints = [simhash.fingerprint(r["text"]) for r in left]
    group = list(range(len(left)))
    for _ in left:
        low = [min(group[j] for j in range(len(left)) if bin(prints[i] ^ prints[j]).count("1") <= 4) for i in range(len(left))]
        if low == group:
            break
        group = low
    order = lambda i: (left[i]["doc_id"] is None, left[i]["doc_id"] or 0)
    kept = [left[min((i for i in range(len(left)) if group[i] == g), key=order)] for g in set(group)]
    item = decontaminate.word_hashes(decontaminate.pa.array([ITEM]))[0][:-1]
    kept = [r for r in kept if decontaminate.aligned(item, decontaminate.word_hashes(decontaminate.pa.array([r["text"] or ""]))[0][:-1])[0] > int(decontaminate.EDITS * len(item))]
    library = sentencepiece_tok.codec(sentencepiece_tok.default_model()).library
    want = sorted(((r["doc_id"] or -1, r["text"] or "", library.encode(r["text"] or "")) for r in kept), key=repr)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert set(docs.columns) <= set(got.columns)
    assert sorted(((r["doc_id"] or -1, r["text"] or "", r["ids"]) for r in got.collect()), key=repr) == want
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_text_operators import ITEM, labelled

    texts, labels = labelled(700)
    copies = [(1000 + i, texts[i]) for i in range(1, 12) if labels[i] == 0]
    leaks = [(2000 + i, f"{texts[1]} {ITEM} {texts[2 + i]}") for i in range(3)]
    docs = spark.createDataFrame([*enumerate(texts), *copies, *leaks], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in got]
    clean = [i for i, y in enumerate(labels) if y == 0]
    assert len(set(ids)) == len(ids) and not set(ids) & {i for i, _ in copies + leaks}
    assert len(set(clean) & set(ids)) >= 0.95 * len(clean)
    assert len(set(ids) - set(clean)) <= 0.05 * (len(labels) - len(clean))
    assert all(r["round_trip"] and len(r["ids"]) == r["n_tokens"] for r in got)
