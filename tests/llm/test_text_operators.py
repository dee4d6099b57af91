import hashlib
import os
import random
import re
import struct
import zlib
from collections import Counter
from html import unescape

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracelake.llm import chat_format, common, decontaminate, gru_lm, html_text, licenses, sentencepiece_tok, token_cache, toxicity
from tracelake.shared import new_path


def texts_of(df):
    return [r["text"] or "" for r in df.collect()]


def test_sentencepiece_parity_and_round_trip(spark, odd_docs, no_docs):
    texts = texts_of(odd_docs) + ["  two  spaces ", "▁mark▁", "<0x0A>\n", "a" * 3000, "né́e ﬁ 𝔘", "\x00\x01"]
    assert sentencepiece_tok.parity(texts) == []
    codec = sentencepiece_tok.codec(sentencepiece_tok.default_model())
    assert codec.plain and codec.encoded(texts).to_pylist() == codec.encode(texts) == codec.library.encode(texts)
    rows = sentencepiece_tok.encoded(odd_docs, check=True)
    assert rows.columns == [c for c in odd_docs.columns if c != "ids"] + ["ids", "n_tokens", "round_trip"]
    got = sentencepiece_tok.decoded(rows).collect()
    assert len(got) == odd_docs.count() and all(r["round_trip"] and r["decoded"] == (r["text"] or "") and r["n_tokens"] == len(r["ids"]) for r in got)
    assert sentencepiece_tok.encoded(no_docs).count() == 0


def _message(*fields):
    """A protobuf message of (number, value) fields."""
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        else:
            wire, body = (0, None) if isinstance(value, int) else (2, value)
            size, tag, coded = value if wire == 0 else len(body), number << 3 | wire, b""
            for x in (tag, size):
                while x > 127:
                    coded, x = coded + bytes([x & 127 | 128]), x >> 7
                coded += bytes([x])
            out += coded + (body or b"")
    return out


def test_sentencepiece_unigram_model(tmp_path):
    """A unigram model put together by hand: its scores, marker and byte fallback give the library's ids."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256))]
    words = ["▁", "▁the", "▁th", "e", "▁cat", "▁ca", "t", "s", "▁cats", "at", "c", "h", "a", "▁▁", "ing", "i", "n", "g"]
    pieces += [(w, -1.0 - 0.37 * i, 1) for i, w in enumerate(words)]
    for extra in (0, 1):
        data = b"".join(_message((1, _message((1, p.encode()), (2, score), (3, kind)))) for p, score, kind in pieces)
        data += _message((2, _message((3, 1), (35, 1)))) + _message((3, _message((1, b"identity"), (3, 1), (4, extra), (5, 1))))
        path = tmp_path / f"unigram{extra}.model"
        path.write_bytes(data)
        codec = sentencepiece_tok.Codec(str(path))
        assert codec.model.kind == sentencepiece_tok.UNIGRAM and codec.model.byte_fallback
        texts = ["the cats", "  the  cat ", "", "catting theing", "dog é 中", "a\nb", "tttt  hehe", " "]
        ids = codec.encoded(texts).to_pylist()
        assert ids == codec.library.encode(texts)
        assert codec.decode(ids) == codec.library.decode(ids)


def test_sentencepiece_decodes_and_compares_every_row(spark, odd_docs, monkeypatch):
    rows = sentencepiece_tok.encoded(odd_docs, check=True, compare=True).collect()
    assert len(rows) == odd_docs.count() and all(r["round_trip"] and r["same_ids"] for r in rows)
    of = sentencepiece_tok.codec(sentencepiece_tok.default_model())
    assert of.same(["some text", "some text"], [of.encode(["some text"])[0], [5]]) == [True, False]
    batch = sentencepiece_tok.pa.record_batch({"doc_id": [1], "text": ["some text"]})
    # a decoder that differs is seen in the row, though the bytes of the ids are the text's
    monkeypatch.setattr(sentencepiece_tok.Codec, "decode", lambda self, ids: ["other"] * len(ids))
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    run = {}
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: run.update(f=f) or self)
    sentencepiece_tok.encoded(docs, check=True, compare=True)
    assert next(run["f"](iter([batch]))).to_pylist()[0]["round_trip"] is False


def test_sentencepiece_unigram_parity(tmp_path):
    import sentencepiece

    rng = np.random.default_rng(1)
    lines = [" ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 7))) for _ in range(12)) for _ in range(300)]
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=iter(lines), model_prefix=f"{tmp_path}/m", model_type="unigram", vocab_size=400, byte_fallback=True, normalization_rule_name="identity",
        remove_extra_whitespaces=False, minloglevel=2,
    )
    texts = [*lines[:50], "", " ", "  two  spaces ", "中文 \n\t é", "aaaa" * 500]
    assert sentencepiece_tok.parity(texts, f"{tmp_path}/m.model") == []
    of = sentencepiece_tok.Codec(f"{tmp_path}/m.model")
    assert of.decode(of.encode(texts)) == texts


def test_token_counts_and_cache(spark, odd_docs, no_docs):
    import sentencepiece

    path = new_path(spark, "cache")
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_tok.default_model())
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(library.encode(r["text"] or ""))) for r in odd_docs.collect())
    for _ in range(2):  # the second time all are in the cache
        got = token_cache.token_counts(odd_docs, path, limit=50).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 50) for r in got)
    cached = spark.read.parquet(path)
    assert cached.count() == cached.select("digest").distinct().count() == odd_docs.selectExpr("coalesce(text, '') AS t").distinct().count()
    assert token_cache.token_counts(no_docs, new_path(spark, "cache")).count() == 0


def test_token_counts_of_a_json_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "some plain words"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_cache.token_counts(docs, new_path(spark, "cache"), path).collect()}
    assert got == {1: len(Tokenizer.from_file(path).encode("some plain words", add_special_tokens=False).ids), 2: 0}


def test_licenses(spark, odd_docs, no_docs):
    rows = [
        (1, "Released under the MIT License. Again: under the MIT-License!"), (2, "Licensed under the Apache Licence, Version 2.0"),
        (3, "Apache License, Version 3"), (4, "CC BY-NC 4.0"), (5, "cc by ncx"), (6, "underthe mit license"), (7, None), (8, "GNU Generel Public License"),
        (9, "under the mit license apache license version 2 cc by nc"),
    ]
    got = {r["doc_id"]: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (2, 1, 6, "mit")
    assert (got[2]["n_base"], got[2]["base_labels"], got[2]["labels"]) == (0, "", "apache-2") and 0.8 < got[2]["score"] < 1
    assert got[2]["spans"][0]["edits"] == 1
    assert got[3]["labels"] == "" and got[4]["base_labels"] == "cc-by-nc" and got[5]["labels"] == ""
    assert got[6]["base_labels"] == "" and got[6]["labels"] == "mit" and got[7]["n_words"] == 0 and got[7]["first_word"] is None
    assert got[8]["labels"] == "gpl" and (got[9]["n_base"], got[9]["first_word"], got[9]["last_word"]) == (3, 0, 8)
    assert licenses.scanned(odd_docs).count() == odd_docs.count() and licenses.scanned(no_docs).count() == 0


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def all_spans(of: licenses.Scanner, text: str) -> list[tuple[int, int, int, int]]:
    """Every run of whole words within a notice's edits; of those that overlap the best."""
    out, cuts = [], [0, *(i + 1 for i, x in enumerate(text) if x == " "), len(text) + 1]
    for k, (notice, _, most) in enumerate(of.notices):
        near, taken = [], []
        for i, s in enumerate(cuts[:-1]):
            for e in (c - 1 for c in cuts[i + 1 :]):
                lacking = sum((Counter(notice) - Counter(text[s:e])).values())  # each is an edit
                if abs(e - s - len(notice)) <= most and lacking <= most and re.findall(r"\d+", text[s:e]) == re.findall(r"\d+", notice):
                    edits = distance(notice, text[s:e])
                    if edits <= most:
                        near.append((edits, s, e))
        for edits, s, e in sorted(near):
            if all(e <= a or b <= s for a, b, _ in taken):
                taken.append((s, e, edits))
        out += [(k, *x) for x in taken]
    return sorted(out, key=lambda x: (x[1], x[0]))


def test_licenses_against_all_runs_of_words():
    """Thousands of random edits, and none within the bound is missed."""
    of, rng, found = licenses.scanner(), random.Random(5), 0
    fixed = ["capache licenbe version 2", "under t bundear the mit license", "under the mit license under the mit licence", "cc by nc cc by nc", ""]
    for n in range(3000):
        if n < len(fixed):
            text = fixed[n]
        else:
            parts = []
            for _ in range(rng.choice((1, 1, 2, 3))):
                notice, _, most = rng.choice(of.notices)
                x = list(notice)
                for _ in range(rng.randint(0, most + 1)):
                    at = rng.randrange(len(x))
                    x[at : at + rng.choice((0, 1))] = rng.choice(("", rng.choice("abt 2"), rng.choice("abt ") + x[at]))
                parts += ["".join(x), *rng.choices(("the", "under", "mit", "apache", "license", "x"), k=rng.randint(0, 3))]
            text = " ".join(" ".join(parts).split())
        want = all_spans(of, text)
        found += len(want)
        assert of.spans(text) == want, text
    assert found > 2000


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href=x>Menu</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; title</h1><p>First   <b>bold
text</b>.<p>Short.</p><form><p>Sign up</p></form><div><p>Third paragraph, which is long enough to matter &eacute;.</p></div></article>
<div id="comments"><p>A reader says something</p></div><aside>Side</aside><footer>Foot</footer></body></html>"""


LONG = "A long sentence of the article that says what there is to say about it, and then some more of it."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f'<nav>Menu</nav><article><div class="entry-header"><h1>Title</h1></div><p>{LONG * 3}</p></article>', ["Title", LONG * 3]),
        (f'<article><p>{LONG * 3}</p><h2 class="section-header">Part</h2><p class="share">Shared</p><p>{LONG}</p></article>', [LONG * 3, "Part", "Shared", LONG]),
        (f'<div class="widget Blog"><p>{LONG * 2}</p><p>{LONG}</p></div><form>Your mail</form>', [LONG * 2, LONG]),
        (f'<ul><li><a href=x>Menu</a></li></ul><h1>Title</h1><div><p>{LONG * 2}</p><p>{LONG}</p></div>', ["Title", LONG * 2, LONG]),
        (f"<h1>Title</h1><article><p>{LONG * 2}</p></article><p>{LONG}</p>", ["Title", LONG * 2]),
        (f"<div><p>{LONG * 9}</p><p>{LONG * 9}</p></div><div><p>Short end.</p></div>", [LONG * 9, LONG * 9, "Short end."]),
        (f'<div class="ad">Buy this now, it is so good that you need it.</div><p>{LONG * 2}</p><p>{LONG}</p><div class="sidebar"><p>Nobody reads this.</p></div>', [LONG * 2, LONG]),
        (f'<article><h1>T</h1><p>{LONG}</p><div id="comments"><p>{LONG * 2}</p></div><section class="user-comment"><p>{LONG}</p></section></article>', ["T", LONG]),
        (f'<div class="cookie-notice"><p>We use cookies, do you agree to that?</p></div><div id=content><h1>T</h1><p>{LONG * 2}</p><p>tiny</p></div><div class=footer><p>c 2020</p></div>', ["T", LONG * 2, "tiny"]),
        (f"<main><article><p>{LONG}</p></article><article><p>{LONG}</p></article></main>", [LONG, LONG]),
    ],
)
def test_html_text_of_odd_pages(html, want):
    assert html_text.main_text(f"<html><body>{html}</body></html>").split("\n") == want


def test_html_text_of_all_pages(spark):
    """Each page's text against its article's blocks, cut out with patterns; repeated rows and clashing columns stay apart."""
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    rows = pq.read_table(f"{sf}/pages.parquet").to_pylist()
    blocks = lambda html: re.split(r"</?(?:h1|p|article)>", re.search(r"<article>.*</article>", html, re.S)[0])
    plain = lambda x: " ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", x))).split())
    want = sorted((r["page_id"], r["url"], "\n".join(filter(None, map(plain, blocks(r["html"]))))) for r in rows)
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumns({"text": F.lit("x"), "n_chars": F.lit("y")})
    got = html_text.extracted(pages.unionByName(pages)).collect()
    assert sorted((r["page_id"], r["url"], r["text"]) for r in got) == sorted(want + want)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_html_text(spark):
    want = "Head & title\nFirst bold text.\nShort.\nThird paragraph, which is long enough to matter é."
    pages = spark.createDataFrame([(1, "u", PAGE, 9), (2, None, None, 9), (3, "u", "", 9), (None, "u", "<p>cut off <b", 9), (4, "u", PAGE[: PAGE.index("Short.") + 6], 9)], "page_id long, url string, html string, n_chars int")
    got = {r["page_id"]: r["text"] for r in html_text.extracted(pages).collect()}
    assert got == {1: want, 2: "", 3: "", None: "cut off", 4: "Head & title\nFirst bold text.\nShort."}
    assert html_text.extracted(pages.limit(0)).count() == 0
    assert html_text.main_text("<div>" + "<p>word</p>" * 20_000 + "</div>") == "\n".join(["word"] * 20_000)


def test_chat_format(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "a </turn>\n### b \\"), (1, 2, "user", None), (2, 1, "assistant", "out of order"), (2, 0, "user", "first"),
        (3, 0, "assistant", "no question"), (None, 0, "user", "x"), (4, None, "user", "a"), (4, None, "user", "a"), (5, 0, None, ":\n###"),
        (6, 0, "user", "x" * 200_000), (6, 1, "assistant", "#<:\\" * 50_000),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("valid", chat_format.F.lit("clash"))
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.formatted(turns)).collect()}
    table = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).fillna({"role": "", "text": "", "turn": -1})
    for conv, group in table.groupby("conv_id", dropna=False):
        group = group.sort_values(["turn", "role", "text"])
        row = got[None if pd.isna(conv) else int(conv)]
        loss = "".join(group.text[group.role == "assistant"])
        assert row["n_turns"] == len(group) and row["loss_chars"] == len(loss)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in zip(group.role, group.text, strict=True)).encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert {k for k, r in got.items() if r["valid"]} == {1, 2, None, 6}
    assert chat_format.formatted(turns.limit(0)).count() == 0


def test_escaping_is_reversible():
    for text in ("", "\\", "\\\\#", "### x: </turn>", "a\\#b"):
        assert chat_format.unescaped(chat_format.escaped(text)) == text


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def test_decontamination(spark, odd_docs, no_docs):
    words = ITEM.split()
    edited = [*words[:5], "other", *words[6:12], *words[13:]]
    noise = " ".join(f"n{i}" for i in range(300))
    docs = spark.createDataFrame(
        [(1, f"{noise} {ITEM.upper()}! {noise}", "c"), (2, f"{noise} {' '.join(edited)} {noise}", "c"), (3, noise, "c"), (4, " ".join(words[:10]), "c"),
         (5, ITEM, "c"), (6, None, "c"), (None, f"x {ITEM}", "c"), (7, "short item here now", "c"), (1, noise, "c")],
        "doc_id long, text string, edits string",
    )
    items = spark.createDataFrame([(10, ITEM), (11, None), (None, ITEM), (12, ""), (13, "short item here")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["first_word"], r["end_word"], r["edits"]) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(1, 10, 300, 320, 0), (2, 10, 300, 319, 2), (5, 10, 0, 20, 0), (None, 10, 1, 21, 0), (7, 13, 0, 3, 0)}
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 6]
    assert decontaminate.leaks(odd_docs, items).count() == 0 and decontaminate.leaks(no_docs, items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0


def test_decontaminate_in_passes(spark):
    """Passes one after another find what one pass does; items with the same text each give a row."""
    rng = random.Random(2)
    items = [(i, " ".join(rng.choices([f"q{k}" for k in range(300)], k=rng.randint(1, 40)))) for i in range(40)]
    items += [(100 + i, items[i][1]) for i in range(5)]
    docs = spark.createDataFrame([(i, f"before {t} after", "x") for i, t in items[:30]] + [(200, "nothing here", "x")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    assert one == sorted(map(tuple, decontaminate.leaks(docs, bench, pass_bytes=1000).collect()))
    assert {(i, i) for i, _ in items[:30]} | {(i, 100 + i) for i in range(5)} <= {r[:2] for r in one}
    assert [r["doc_id"] for r in decontaminate.clean(docs, bench, pass_bytes=1000).collect()] == [200] == [r["doc_id"] for r in decontaminate.clean(docs, bench).collect()]


def test_decontaminate_words_beyond_ascii():
    index = decontaminate.Index.of([1, 2, 3], ["one two three four five six", "今日は晴れです明日も", "naïve café déjà vu encore une"])
    texts = ["so “one two”—three four\u00a0five… six!", "昨日と今日は晴れです明日もきっと", "NAÏVE café – déjà vu, encore «une»", "昨日の雨"]
    assert [(t, i, e) for t, i, _, _, e in index.matches(decontaminate.pa.array(texts))] == [(0, 0, 0), (1, 1, 0), (2, 2, 0)]


def test_edit_distance_matches_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        item, near = rng.integers(1, 5, rng.integers(1, 9)).astype(np.uint64), rng.integers(1, 5, rng.integers(0, 14)).astype(np.uint64)

        def plain(a, b):
            row = list(range(len(b) + 1))
            for i, x in enumerate(a):
                new = [i + 1]
                for j, y in enumerate(b):
                    new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
                row = new
            return row[-1]

        best = min(plain(item, near[s:e]) for s in range(len(near) + 1) for e in range(s, len(near) + 1))
        edits, s, e = decontaminate.aligned(item, near)
        assert edits == best == plain(item, near[s:e])


def test_decontamination_misses_no_item_within_its_edits():
    """Items of every length with as many edits as allowed, spread or together, against brute force."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(200)]
    items, texts = [], []
    for n in range(1, 81):
        for together in (False, True):
            item = list(rng.choice(vocabulary, n))
            items.append(" ".join(item))
            most = int(decontaminate.EDITS * n)
            first = int(rng.integers(n - most + 1))
            for at in sorted(range(first, first + most) if together else rng.choice(n, most, replace=False).tolist(), reverse=True):
                kind = rng.integers(3)
                item[at : at + 1] = [[f"x{at}"], [], [item[at], f"x{at}"]][kind]
            noise = [" ".join(rng.choice(vocabulary, rng.integers(0, 60))) for _ in range(2)]
            texts.append(f"{noise[0]} {' '.join(item)} {noise[1]}")
    index = decontaminate.Index.of(list(range(len(items))), items)
    got = {(t, i): edits for t, i, _, _, edits in index.matches(decontaminate.pa.array(texts))}
    words, starts = decontaminate.word_hashes(decontaminate.pa.array(texts))
    assert all((t, t) in got for t in range(len(texts)))
    for t in range(len(texts)):
        for i in {t, *rng.integers(0, len(items), 4).tolist()}:
            own = index.words[index.starts[i] : index.starts[i + 1] - 1]
            edits = decontaminate.aligned(own, words[starts[t] : starts[t + 1] - 1])[0]
            assert got.get((t, i)) == (edits if edits <= int(decontaminate.EDITS * len(own)) else None)


def labelled(n, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("sa", "no", "pe", "di", "fu", "gor", "lim")]
    texts, labels = [], []
    for i in range(n):
        text = list(rng.choice(words, rng.integers(20, 160)))
        if i % 3 == 0:
            for _ in range(3):
                text[rng.integers(len(text))] = "zorg" + rng.choice(words)
        texts.append(" ".join(text))
        labels.append(int(i % 3 == 0))
    return texts, labels


def test_toxicity_learns_a_prefix(spark, no_docs):
    texts, labels = labelled(500)
    rows = [(i, t) for i, t in enumerate(texts)] + [(9000, None), (9001, ""), (9002, "ka " * 50_000), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, x) for i, x in enumerate(labels)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.model_for(docs, marks)
    got = toxicity.scored(docs.withColumn("score", chat_format.F.lit("clash")), model).select("doc_id", "score", (common.in_fold(chat_format.F.col("doc_id"), 5) == 0).alias("held")).collect()
    held = [(labels[r["doc_id"]], r["score"]) for r in got if r["held"] and r["doc_id"] is not None and r["doc_id"] < 9000]
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([(s >= 0.5) == y for y, s in held]) > 0.9
    assert toxicity.scored(no_docs, model).count() == 0
    assert toxicity.accepted(docs, marks.limit(0)).columns == docs.columns


def test_toxicity_gradients():
    m = toxicity.Model.new(1)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    rng = np.random.default_rng(2)
    x, at, y = rng.standard_normal((6, 2 * toxicity.DIM)), rng.integers(-1, 6, (4, 5)), np.array([0, 1, 1, 0])
    at[:, 0] = 1
    at = np.where(np.minimum.accumulate(at, axis=1) < 0, -1, at)

    def loss():
        z = m.pooled(m.states(m.projected(x), at)[0], at)[0]
        return float(np.mean(np.logaddexp(0, z) - y * z))

    grads, dx = toxicity._gradients(m, x, at, y)
    for name, g, w in [(k, grads[k], m.w[k]) for k in grads] + [("x", dx, x)]:
        i = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, h = w[i], 1e-3
        w[i] = old + h
        up = loss()
        w[i] = old - h
        down = loss()
        w[i] = old
        assert g[i] == pytest.approx((up - down) / (2 * h), rel=0.05, abs=1e-4), name


def test_language_model(spark, odd_docs, no_docs):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice([f"a{j}" if i % 2 else f"b{j}" for j in range(30)], 60))) for i in range(300)] + [(901, None), (902, ""), (None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in gru_lm.scored(docs).collect()}
    assert len(got) == len(rows) and got[902]["n_tokens"] == got[901]["n_tokens"] == 1
    held = [r for r in got.values() if r["held_out"] and (r["doc_id"] or 1000) < 900]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert gru_lm.scored(odd_docs).count() == odd_docs.count() and gru_lm.scored(no_docs).count() == 0


def test_language_model_trains_on_every_token(spark):
    """The tokens that the rounds read are those of all texts, each once."""
    texts = [None, "", "a b", *(" ".join(f"w{k % 7}" for k in range(n)) for n in (100, 3000, 9000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = gru_lm.vocabulary_of(gru_lm.token_counts(docs))
    shared = spark.sparkContext.broadcast((words, gru_lm.Network(words).flat))
    for rounds in (1, 2, 3):
        changes = [gru_lm.changes_of(gru_lm.round_of(docs, k, rounds), shared, 2) for k in range(rounds)]
        read = sum(r["read"] for c in changes for r in c.where("chunk = 0").collect())
        assert read == words.n == sum(len(gru_lm.tokens_of(t)) + 1 for t in texts)


def test_language_model_on_the_table_dealt_otherwise(spark):
    """The same documents in other partitions have the same scores; base and counts are those of plain SQL."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice([f"w{int(j)}" for j in rng.zipf(1.5, 40)], rng.integers(0, 200)))) for i in range(120)] + [(500, None), (501, "É é\tÉ  x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a = gru_lm.scored(docs.repartition(1)).toPandas().sort_values("doc_id", ignore_index=True)
    b = gru_lm.scored(docs.repartition(5, "text")).toPandas().sort_values("doc_id", ignore_index=True)
    assert np.allclose(a["score"], b["score"], rtol=1e-5) and a.drop(columns=["score", "base_score"]).equals(b.drop(columns=["score", "base_score"]))
    train = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in [*gru_lm.tokens_of(t), b"\n"])
    n, v = sum(train.values()), len(train)
    for r, (i, t) in zip(a.to_dict("records"), sorted(rows), strict=True):
        words = [*gru_lm.tokens_of(t), b"\n"]
        want = sum(np.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, len(words), sum(w in train for w in words), n)
        assert r["base_score"] == pytest.approx(want, rel=1e-9) and r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)


def test_language_model_sums_to_one_and_gradients():
    counts = {w.encode(): c for w, c in zip("abcdefgh", range(9, 1, -1), strict=True)}
    words = gru_lm.Vocabulary(
        44, 8, {w: i for i, w in enumerate(counts)}, np.array(list(counts.values())), np.arange(8, dtype=np.int32), 8, np.array([0, 2, 5, 8]),
        np.full(gru_lm.ENDING_CLASSES, 0.1), np.zeros(3 + gru_lm.ENDING_CLASSES, np.float32),
    )
    net, rng = gru_lm.Network(words), np.random.default_rng(0)
    net.flat = net.flat.astype(np.float64)
    net.w = net.parts(net.flat)
    s = np.append(rng.standard_normal((1, gru_lm.HIDDEN)), [[1.0]], axis=1)
    every = np.arange(8 + gru_lm.ENDING_CLASSES)
    for bounded in (True, False):
        assert np.exp(net.log_probabilities(np.repeat(s, len(every), 0), every, bounded)).sum() == pytest.approx(1, rel=1e-5)
    symbols, states = np.array([0, 3, 7, 9]), np.append(rng.standard_normal((4, gru_lm.HIDDEN)), np.ones((4, 1)), axis=1)
    grads = {k: np.zeros(v) for k, v in net.shapes.items()}
    net.log_probabilities(states, symbols, True, grads)
    for name in ("class", "word"):
        i = np.unravel_index(np.argmax(np.abs(grads[name])), grads[name].shape)
        w, h = net.w[name], 1e-4
        w[i] += h
        up = -net.log_probabilities(states, symbols, True).mean()
        w[i] -= 2 * h
        down = -net.log_probabilities(states, symbols, True).mean()
        w[i] += h
        assert grads[name][i] == pytest.approx((up - down) / (2 * h), rel=0.05, abs=1e-5), name


def test_language_model_backpropagation():
    """Gradients of the recurrent weights, over two documents side by side."""
    words = gru_lm.Vocabulary(
        44, 8, {}, np.arange(8, 0, -1), np.arange(8, dtype=np.int32), 8, np.array([0, 2, 5, 8]), np.full(gru_lm.ENDING_CLASSES, 0.1), np.zeros(3 + gru_lm.ENDING_CLASSES, np.float32)
    )
    docs = [np.array([1, 2, 3, 4, 5, 0]), np.array([7, 6, 0])]

    def loss(net):
        inputs, targets, fresh, number = gru_lm.streams(docs, gru_lm.lanes_of(docs, 2), 0)
        states, _ = net.states(net.projected(inputs), fresh, np.zeros((2, gru_lm.HIDDEN), np.float32))
        there = number.ravel() >= 0
        return -net.log_probabilities(states.reshape(-1, gru_lm.HIDDEN + 1)[there], targets.ravel()[there], True).astype(float).mean()

    net = gru_lm.Network(words)
    before, squares = gru_lm.Network(words, net.flat), np.full_like(net.flat, 1e12)  # so large that the step is the gradient, scaled
    gru_lm.train_on(net, docs, 0, squares)
    step = gru_lm.Network(words, (before.flat - net.flat) * 1e6 / gru_lm.RATE)
    for name in ("embed", "x", "h", "b"):
        g = step.w[name]
        i = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        w, h = before.w[name], 1e-2
        w[i] += h
        up = loss(before)
        w[i] -= 2 * h
        down = loss(before)
        w[i] += h
        assert (up - down) / (2 * h) == pytest.approx(float(g[i]), rel=0.2, abs=5e-3), name


def test_language_model_words_are_those_of_the_base():
    texts = ["  Ab\x0b c\x1c d\n\n\u00a0e ", "", None, "É é É", "x" * 5000]
    words = gru_lm.Vocabulary(10, 2, {b"c": 0}, np.array([3]), np.array([0], np.int32), 1, np.array([0, 1]), np.full(gru_lm.ENDING_CLASSES, 0.1), np.zeros(1 + gru_lm.ENDING_CLASSES, np.float32))
    got = gru_lm._Scorer(words, gru_lm.Network(words).flat).score(gru_lm.pa.array(texts))
    assert got["n_tokens"].to_pylist() == [len(gru_lm.tokens_of(t)) + 1 for t in texts] and got["n_known"].to_pylist() == [0, 0, 0, 0, 0]
    assert [sorted((x["token"], x["n"]) for x in r if x["token"] != "\n") for r in got["rare"].to_pylist()] == [
        sorted((k.decode(), n) for k, n in gru_lm.Counter(gru_lm.tokens_of(t)).items() if k != b"c") for t in texts
    ]
