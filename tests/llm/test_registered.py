"""The registered queries on given tables, against SQL or plain versions."""

import os
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from tracelake.llm import licenses, queries, token_cache

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def column(table, name):
    return pq.read_table(f"{SF}/{table}.parquet", columns=[name]).column(0).to_pylist()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_licenses_base_columns(spark):
    """Base places, counted word by word over all documents."""
    phrases = {tuple(p.split()): label for p, label in licenses.BASE}
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_licenses"](spark, SF).collect()}
    texts = dict(zip(column("documents", "doc_id"), column("documents", "text"), strict=True))
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = [(k, label) for p, label in phrases.items() for k in range(len(words)) if tuple(words[k : k + len(p)]) == p]
        r, at = got[i], [k for k, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_token_counts_of_all_documents(spark):
    count = token_cache._counter(token_cache.default_model())
    ids, texts = column("documents", "doc_id"), [t or "" for t in column("documents", "text")]
    want = sorted((i, len(t.encode()), n, n > 4096) for i, t, n in zip(ids, texts, count(texts), strict=True))
    got = queries.QUERIES["op10_token_counts"](spark, SF)
    assert sorted(tuple(r[c] for c in ("doc_id", "n_bytes", "n_tokens", "over_limit")) for r in got.collect()) == want


def test_toxicity_held_out_labels(spark):
    """Held out labels of a table with enough of them: the score puts toxic documents above clean ones."""
    sf = "/root/testdata/sf0.1"
    labels = pq.read_table(f"{sf}/labels.parquet")
    toxic = dict(zip(labels.column("doc_id").to_pylist(), labels.column("toxic").to_pylist(), strict=True))
    rows = [r for r in queries.QUERIES["op2_toxicity"](spark, sf).collect() if r["held_out"] and toxic.get(r["doc_id"]) is not None]
    good, bad = (np.array([r["score"] for r in rows if toxic[r["doc_id"]] == y]) for y in (0, 1))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert len(bad) > 50 and np.mean([np.mean(x > good) for x in bad]) >= 0.9


def test_sentencepiece_of_all_documents(spark):
    rows = queries.QUERIES["op8_sentencepiece"](spark, SF).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(column("documents", "doc_id"))
    assert all(r["round_trip"] and r["same_ids"] and len(r["ids"]) == r["n_tokens"] for r in rows)
