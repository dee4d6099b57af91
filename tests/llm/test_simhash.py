import random

import numpy as np
import xxhash

from tracelake.llm import simhash
from tracelake.operators.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_of_odd_texts(spark, odd_docs):
    got = {(r["doc_id"], r["fingerprint"]) for r in simhash.near_duplicates(odd_docs).collect()}
    assert got == {(r["doc_id"], f"{plain_fingerprint(r['text']):016x}") for r in odd_docs.collect()}


def test_components_of_odd_texts(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert of[1] == of[2] == {1} and of[7] == {7} and of[4] == of[5] == of[6] == {4}
    assert len(rows) == odd_docs.count()
    assert simhash.near_duplicates(no_docs).count() == 0


def test_links_match_brute_force(spark):
    rng = random.Random(2)
    fps = set()
    for _ in range(60):
        c = rng.getrandbits(64)
        for _ in range(12):
            fps.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))))
    hub = rng.getrandbits(64)
    fps |= {hub ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)}  # one large ball
    x = np.array(sorted(fps), np.uint64)
    near = [(int(x[i]), int(x[j])) for i in range(len(x)) for j in (np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 4) + i + 1)]
    want = roots(near, [int(v) for v in x])
    frame = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    got = roots([(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(frame).collect()], [int(v) for v in x])
    groups = lambda m: sorted(sorted(k for k in m if m[k] == r) for r in set(m.values()))
    assert groups(got) == groups(want)


def test_thresholds_add_up():
    rng = np.random.default_rng(1)
    bits = (rng.random((5000, 64)) < 0.5).astype(float)
    for n in (100, 10**6, 10**10):
        chosen = simhash.plan(n, bits.T @ bits / 5000 * n, 4)
        assert sum(t for _, t in chosen) == 4 - len(chosen) + 1
        assert sorted(b for part, _ in chosen for b in part) == list(range(64))


def test_one_row_of_each_component_stays(spark, odd_docs, no_docs):
    kept = simhash.kept_documents(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    want = {r["component_id"] if r["component_id"] is not None else r["fingerprint"] for r in simhash.near_duplicates(odd_docs).collect()}
    assert len(ids) == len(want)
    assert simhash.kept_documents(no_docs).count() == 0


def test_components_of_paths_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 200)] + [(5, 5), (300, 301), (301, 300)]
    got = {r["vertex"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {n: r for n, r in roots([p for p in pairs if p[0] != p[1]], {n for p in pairs for n in p}).items() if n != r}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
