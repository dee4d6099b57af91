"""F1 of the third review: what the language model does for a token."""

import numpy as np

from tracelake.llm import gru_lm


def test_a_token_meets_few_logits(spark):
    """Of words whose counts fall as 1 / rank, a token meets its group's, its class's and few words' logits."""
    counts = spark.createDataFrame([(f"w{i}", 1 + 20_000 // i) for i in range(1, 1001)], "token string, c long")
    words = gru_lm.vocabulary_of(counts)
    net = gru_lm.Network(words)
    every = net.parts(np.zeros_like(net.flat))
    met, widths = np.zeros(words.own), np.diff(words.class_starts)
    met += np.repeat(np.where(widths > 1, widths, 0), widths)
    mass = words.count[: words.own] / words.count[: words.own].sum()
    above = every["group"].shape[0] + np.diff(net.group_starts).max()
    assert above < 40 < words.classes and (met * mass).sum() + above < 50


def test_encoded_documents(spark):
    """Symbols are those of the tokens of each text, whatever its white space; training reads them as it reads texts."""
    texts = ["  Ab\x0b c\x1c d\n\n e ", "", None, "É é É", " ".join(f"w{i % 50}" for i in range(3000)), "ab c W1 w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("deal", gru_lm.dealing())
    words = gru_lm.vocabulary_of(gru_lm.token_counts(docs))
    shared = spark.sparkContext.broadcast((words, gru_lm.Network(words).flat))
    coded = gru_lm.encoded(docs, shared)
    got = {r["doc_id"]: np.frombuffer(r["symbols"], gru_lm.SYMBOL).tolist() for r in coded.select("doc_id", "symbols").collect()}
    assert got == {i: [int(words.symbol[words.number[w]]) for w in [*gru_lm.tokens_of(t), gru_lm.END]] for i, t in enumerate(texts)}
    a, b = (gru_lm.averaged(gru_lm.changes_of(d, shared, 2), 2) for d in (coded, docs))
    assert np.allclose(a, b, atol=1e-6) and np.abs(a).max() > 0
