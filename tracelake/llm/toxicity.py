"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A word enters as an embedding of itself and the highest values over the
embeddings of its character n-grams. Both directions of the network read windows of words that overlap;
attention pools a window's states into one logit. A document's logit is that of
its worst window, scaled by a logistic fit on whole training documents.

Training (numpy, on the driver) uses a bounded, stated number of labelled rows.
Only documents are labelled, so their windows are chosen in rounds: first by how
much words and n-grams set the two labels apart, then by the network itself.
Scoring runs in Spark over every window of every text.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import in_fold, kept, one_thread, released, table, with_fields

WINDOW, STRIDE = 48, 32
HIDDEN, DIM = 16, 16
WORD_ROWS = GRAM_ROWS = 1 << 15
GRAMS = (3, 4, 5, 6)
#: Labelled rows with label 0 and with label 1 that training reads at most, whole texts, chosen by a hash of the id.
TRAIN_ROWS = (3000, 1500)
EPOCHS, ROUNDS, BATCH = 2, 4, 128
#: Share of a batch's words that keep their own embedding in training.
HEARD = 0.5
#: Of so many training documents one is left to the logistic fit.
FIT_FOLD = 5
#: Words whose features are made at once.
PART = 20_000
#: Words whose projections a worker keeps.
KEPT_WORDS = 150_000
EDGE = string.punctuation + "¿¡«»“”„’‘–—…"


def words_of(text: str | None) -> list[str]:
    return [w.strip(EDGE) or w for w in (text or "").lower().split()]


def windows_of(n: int) -> list[int]:
    """Starts of the windows over n words: every STRIDE words, the last one at
    the end, so that each word is in one at least. No words: one empty window."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word's own embedding; rows of its n-grams, all words' one
    after another; where each word's n-grams start (and, last, end)."""
    text = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(text))  # characters up to the word's end
    powers = np.uint64(0x100000001B3) ** np.arange(int(sizes.max(initial=1)) + 1, dtype=np.uint64)
    place = np.arange(len(text)) - np.repeat(ends - sizes, sizes)
    whole = np.add.reduceat(_mixed(text + np.uint64(7)) * powers[place], ends - sizes)
    own = (_mixed(whole) % np.uint64(WORD_ROWS)).astype(np.int64)
    rows, at = [], []
    for n in GRAMS:
        ok = np.flatnonzero(left >= n)
        h = np.full(len(ok), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + text[ok + k]
        rows.append((_mixed(h) % np.uint64(GRAM_ROWS)).astype(np.int64))
        at.append(np.searchsorted(ends, ok, "right"))
    rows, at = np.concatenate(rows), np.concatenate(at)
    order = np.argsort(at, kind="stable")
    return own, rows[order], np.searchsorted(at[order], np.arange(len(words) + 1))


def features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`word_features` of many words, a part of them at a time and in small integers."""
    found = [word_features(words[i : i + PART]) for i in range(0, len(words), PART)]
    before = np.cumsum([0, *(len(rows) for _, rows, _ in found)])
    starts = [s[:-1] + b for (_, _, s), b in zip(found, before, strict=False)]
    return np.concatenate([o for o, _, _ in found]), np.concatenate([r.astype(np.int32) for _, r, _ in found]), np.append(np.concatenate(starts), before[-1])


def _highest(table: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Highest value of each column over the table's rows of each run of `rows`;
    zero for an empty run."""
    out = np.zeros((len(starts) - 1, table.shape[1]), np.float32)
    some = np.flatnonzero(starts[1:] > starts[:-1])
    for at in range(0, len(some), 20_000):
        part = some[at : at + 20_000]
        got = table[rows[starts[part[0]] : starts[part[-1] + 1]]]
        out[part] = np.maximum.reduceat(got, starts[part] - starts[part[0]])
    return out


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the values by row: the rows that occur, and their sums."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    return rows[first], np.add.reduceat(values[order], first)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Model:
    """Weights by name, and the logistic fit from a worst window's logit to a probability."""

    w: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0

    @staticmethod
    def new(seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        w = {"words": draw(WORD_ROWS, DIM, scale=0.05), "grams": draw(GRAM_ROWS, DIM, scale=0.1)}
        for d in ("f", "b"):
            w[f"x{d}"] = draw(2 * DIM, 3 * HIDDEN, scale=(2 * DIM) ** -0.5)
            w[f"h{d}"] = draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)
            w[f"c{d}"] = np.zeros(3 * HIDDEN, np.float32)
        return Model(w | {"attend": draw(2 * HIDDEN, scale=0.3), "out": draw(2 * HIDDEN, scale=0.3), "bias": np.array([-1.0], np.float32)})

    def inputs(self, features: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        own, rows, starts = features
        return np.concatenate([self.w["words"][own], _highest(self.w["grams"], rows, starts)], axis=1)

    def projected(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.w["xf"] + self.w["cf"], x @ self.w["xb"] + self.w["cb"]

    def states(self, proj: tuple[np.ndarray, np.ndarray], at: np.ndarray, keep: bool = False):
        """States (steps, windows, both directions) for windows of rows `at` of
        the projections; -1 is no word and leaves the state as it is."""
        n, steps = at.shape
        out = np.zeros((steps, n, 2 * HIDDEN), np.float32)
        full = at.min(initial=0) >= 0
        kept = {}
        for k, d in enumerate("fb"):
            h, u = np.zeros((n, HIDDEN), np.float32), self.w[f"h{d}"]
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                x = proj[k][at[:, t]]
                hu = h @ u
                zr = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                new = c + z * (h - c)
                if not full:
                    new = np.where(at[:, t, None] >= 0, new, h)
                if keep:
                    kept[d, t] = (h, z, r, c, hu[:, 2 * HIDDEN :])
                out[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h = new
        return out, kept

    def pooled(self, states: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, attention (steps, windows) and pooled states."""
        e = states @ self.w["attend"]
        e[at.T < 0] = -1e9
        e -= e.max(0)
        a = np.exp(e)
        a[at.T < 0] = 0
        a /= np.maximum(a.sum(0), 1e-9)
        p = np.einsum("tn,tnh->nh", a, states)
        return p @ self.w["out"] + self.w["bias"][0], a, p

    def logits(self, proj: tuple[np.ndarray, np.ndarray], at: np.ndarray, size: int = 2048) -> np.ndarray:
        return np.concatenate([self.pooled(self.states(proj, at[i : i + size])[0], at[i : i + size])[0] for i in range(0, len(at), size)])

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -30, 30)))


def _gradients(m: Model, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the mean logistic loss by weight, and by row of x."""
    states, kept = m.states(m.projected(x), at, keep=True)
    logit, a, p = m.pooled(states, at)
    g = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
    out = {"out": p.T @ g, "bias": np.array([g.sum()], np.float32)}
    dp = g[:, None] * m.w["out"]
    da = np.einsum("tnh,nh->tn", states, dp)
    de = a * (da - (a * da).sum(0))
    out["attend"] = np.einsum("tn,tnh->h", de, states)
    ds = a[:, :, None] * dp + de[:, :, None] * m.w["attend"]
    dx = np.zeros_like(x)
    steps = at.shape[1]
    said = at.T.ravel() >= 0
    for k, d in enumerate("fb"):
        u = m.w[f"h{d}"]
        du, dproj = np.zeros_like(u), np.zeros((len(x), 3 * HIDDEN), np.float32)
        each = np.zeros((steps, len(at), 3 * HIDDEN), np.float32)
        dh = np.zeros((len(at), HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
            dh = dh + ds[t, :, k * HIDDEN : (k + 1) * HIDDEN]
            h, z, r, c, hc = kept[d, t]
            here = (at[:, t, None] >= 0).astype(np.float32)
            dn = dh * here
            dc = dn * (1 - z) * (1 - c * c)
            dz = dn * (h - c) * z * (1 - z)
            dr = dc * hc * r * (1 - r)
            each[t] = np.concatenate([dz, dr, dc], axis=1)
            du3 = np.concatenate([dz, dr, dc * r], axis=1)
            du += h.T @ du3
            dh = dh * (1 - here) + dn * z + du3 @ u.T
        named, total = _summed(at.T.ravel()[said], each.reshape(-1, 3 * HIDDEN)[said])
        dproj[named] = total
        out[f"h{d}"], out[f"c{d}"], out[f"x{d}"] = du, dproj.sum(0), x.T @ dproj
        dx += dproj @ m.w[f"x{d}"].T
    return out, dx


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, w: dict[str, np.ndarray], grads: dict[str, np.ndarray | tuple]) -> None:
        """Rows that a sparse gradient (rows, values) doesn't name stay as they are."""
        self.t += 1
        for k, g in grads.items():
            rows, g = g if isinstance(g, tuple) else (slice(None), g)
            if k not in self.m:
                self.m[k], self.v[k] = np.zeros_like(w[k]), np.zeros_like(w[k])
            self.m[k][rows] = 0.9 * self.m[k][rows] + 0.1 * g
            self.v[k][rows] = 0.99 * self.v[k][rows] + 0.01 * g * g
            w[k][rows] -= self.rate * (self.m[k][rows] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k][rows] / (1 - 0.99**self.t)) + 1e-6)


def _apart(rows_of_docs: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """For each feature, how many standard errors its share of documents is
    higher under label 1, over ten, from -1 to 3."""
    seen = np.zeros((2, size))
    for rows, label in zip(rows_of_docs, y, strict=True):
        seen[label][rows] += 1
    n1, n0 = max(1, y.sum()), max(1, (1 - y).sum())
    p1, p0, p = seen[1] / n1, seen[0] / n0, (seen[0] + seen[1] + 1) / (n0 + n1 + 2)
    return np.clip((p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)) / 10, -1, 3).astype(np.float32)


def trained(texts: list[str], labels: list[int], rate_of_ones: float | None = None, seed: int = 5) -> Model:
    """A model from labelled texts; `rate_of_ones`: the share of label 1 to
    calibrate for (that of `labels` by default). With one label only, every
    score is that label's rate."""
    m, y = Model.new(seed), np.array(labels, np.int64)
    rng = np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        m.slope, m.shift = 0.0, float(np.log(p / (1 - p))) if len(y) else -1e-6
        return m
    vocabulary: dict[str, int] = {}
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int32) for t in texts]
    own, rows, starts = features_of(list(vocabulary) or ["-"])
    del vocabulary
    lengths = starts[1:] - starts[:-1]

    def grams_of(words: np.ndarray) -> np.ndarray:
        """The n-gram rows of some words, one after another."""
        n = lengths[words]
        return rows[np.repeat(starts[words] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    fit = np.zeros(len(y), bool)
    for label in (0, 1):
        fit[np.flatnonzero(y == label)[FIT_FOLD - 1 :: FIT_FOLD]] = True
    uniques = [np.unique(d) for d, f in zip(ids, fit, strict=True) if not f]
    by_word = _apart([np.unique(own[u]) for u in uniques], y[~fit], WORD_ROWS)
    by_gram = _apart([np.unique(grams_of(u)) for u in uniques], y[~fit], GRAM_ROWS)
    m.w["words"][:, 0], m.w["grams"][:, 0] = by_word, by_gram
    best_gram = np.zeros(len(own), np.float32)
    some = lengths > 0
    best_gram[some] = np.maximum.reduceat(by_gram[rows], starts[:-1][some])
    worth = np.maximum(by_word[own], best_gram)

    at, doc = [], []
    for k, d in enumerate(ids):
        for s in windows_of(len(d)):
            part = d[s : s + WINDOW]
            at.append(np.pad(part, (0, WINDOW - len(part)), constant_values=-1).astype(np.int32))
            doc.append(k)
    at, doc = np.array(at), np.array(doc)
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    score = np.where(at >= 0, worth[at], -1).max(1)
    adam = _Adam(0.005)
    for _ in range(ROUNDS):
        # Of each document its worst window so far; of the clean ones another as well.
        order = np.lexsort((-score, doc))
        chosen = [order[first]]
        second = order[np.minimum(first + 1, np.append(first[1:], len(doc)) - 1)]
        chosen.append(second[y[doc[second]] == 0])
        clean = np.flatnonzero(y[doc] == 0)
        chosen.append(rng.choice(clean, min(len(clean), len(texts) // 2), replace=False))
        chosen = np.unique(np.concatenate(chosen))
        chosen = chosen[~fit[doc[chosen]]]
        for _ in range(EPOCHS):
            chosen = rng.permutation(chosen)
            for i in range(0, len(chosen), BATCH):
                part = chosen[i : i + BATCH]
                words, where = np.unique(at[part], return_inverse=True)
                where = where.reshape(len(part), WINDOW)
                if words[0] == -1:
                    words, where = words[1:], where - 1
                n = lengths[words]
                grams = grams_of(words)
                x = m.inputs((own[words], grams, np.append(0, np.cumsum(n))))
                heard = rng.random(len(words)) < HEARD
                x[:, :DIM] *= heard[:, None]  # else words themselves are learned by heart
                grads, dx = _gradients(m, x, where, y[doc[part]])
                grads["words"] = _summed(own[words], dx[:, :DIM] * heard[:, None])
                highest = m.w["grams"][grams] == np.repeat(x[:, DIM:], n, axis=0)
                grads["grams"] = _summed(grams, highest * np.repeat(dx[:, DIM:], n, axis=0))
                adam.step(m.w, grads)
        # in parts of the vocabulary, for the memory between
        parts = [m.projected(m.inputs((own[i : i + PART], rows, starts[i : i + PART + 1]))) for i in range(0, len(own), PART)]
        score = m.logits(tuple(np.concatenate(p) for p in zip(*parts, strict=True)), at)
        del parts
    worst = np.maximum.reduceat(score, first)
    rate = rate_of_ones if rate_of_ones is not None else float(y.mean())
    held = fit if y[fit].any() else ~fit  # too few documents for a fold
    m.slope, m.shift = _logistic(worst[held], y[held], rate)
    return m


def _logistic(x: np.ndarray, y: np.ndarray, rate: float) -> tuple[float, float]:
    """Slope and shift of a logistic fit, rows weighted to the given rate of ones
    and pulled a little to the middle."""
    rate = min(max(rate, 0.01), 0.99)
    weight = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))
    target = np.where(y == 1, 1 - 0.01, 0.01)
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (p - target) * x).sum() + 0.1 * (a - 1), (weight * (p - target)).sum()])
        s = weight * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(s * x * x).sum() + 0.1, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    return float(a), float(b)


class _Scorer:
    """Scores texts; keeps the projections of words met before."""

    def __init__(self, model: Model):
        self.m = model
        self.rows: dict[str, int] = {}
        # room for the words of a last run beyond those kept, so that it rarely has to grow
        self.proj = [np.empty((KEPT_WORDS + 30_000, 3 * HIDDEN), np.float32) for _ in range(2)]

    def _rows(self, words: list[str]) -> np.ndarray:
        """Rows of a run of words, new ones added."""
        get = self.rows.get
        at = np.array([get(w, -1) for w in words], np.int64)
        if len(missing := np.flatnonzero(at < 0)):
            new = list(dict.fromkeys(words[i] for i in missing))
            n = len(self.rows)
            found = self.m.projected(self.m.inputs(word_features(new)))
            for k in range(2):
                if n + len(new) > len(self.proj[k]):
                    self.proj[k] = np.concatenate([self.proj[k][:n], np.empty((len(new), 3 * HIDDEN), np.float32)])
                self.proj[k][n : n + len(new)] = found[k]
            self.rows.update(zip(new, range(n, n + len(new)), strict=True))
            at[missing] = [get(words[i]) for i in missing]
        return at

    def worst(self, texts: list[str | None]) -> np.ndarray:
        """The logit of each text's worst window. Texts are taken in runs, and
        the windows of a run in chunks, so memory is bounded by the longest text."""
        out, run, size = [], [], 0
        for text in texts:
            run.append(words_of(text))
            size += len(run[-1])
            if size > 60_000:
                out.append(self._run(run))
                run, size = [], 0
        if run:
            out.append(self._run(run))
        return np.concatenate(out) if out else np.zeros(0)

    def _run(self, docs: list[list[str]]) -> np.ndarray:
        if len(self.rows) > KEPT_WORDS:
            self.rows = {}
        rows = self._rows([w for d in docs for w in d])
        begin = np.cumsum([0, *(len(d) for d in docs)])
        starts = [windows_of(len(d)) for d in docs]
        first = np.cumsum([0, *(len(s) for s in starts)])[:-1]
        at = np.concatenate([np.array(s) + b for s, b in zip(starts, begin, strict=False)])[:, None] + np.arange(WINDOW)
        ends = np.repeat(begin[1:], [len(s) for s in starts])[:, None]
        inside = at < ends
        at = np.where(inside, np.append(rows, -1)[np.minimum(at, len(rows))], -1)
        whole = inside.all(1)  # full windows first: their steps need no masks
        logits = np.empty(len(at), np.float32)
        for group in (np.flatnonzero(whole), np.flatnonzero(~whole)):
            if len(group):
                logits[group] = self.m.logits(self.proj, at[group])
        return np.maximum.reduceat(logits, first)


def training_rows(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = TRAIN_ROWS) -> tuple[pd.DataFrame, float]:
    """Texts and labels of at most `most` documents of either label that
    aren't held out, smallest hash of the id first; and the share of label 1
    among all such labels. Labels or ids that are null teach nothing, nor do
    those of documents that aren't there; of several labels for an id the largest
    counts. The driver gets that many texts, as long as they are."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(in_fold(F.col("doc_id"), 5) != 0)
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("toxic") >= 1, 1).otherwise(0)).alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    usable = usable.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    share = usable.agg(F.avg("toxic").alias("share")).first()["share"]
    picked = [usable.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[c]) for c in (0, 1)]
    few = F.broadcast(picked[0].unionByName(picked[1]))  # at most the sum of `most` rows
    rows = texts.join(few, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    return rows.toPandas().sort_values("doc_id"), float(share or 0.0)


def model_for(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = TRAIN_ROWS) -> Model:
    rows, share = training_rows(docs, labels, most)
    model = trained(rows["text"].tolist(), rows["toxic"].astype(int).tolist(), share)
    del rows
    released()  # the driver gives back what training took
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with one more column, score (0 to 1), which replaces one of that
    name. A null text counts as an empty one, scored as a window without words.
    Repeated rows, null ids and all other columns stay; an empty table gives an
    empty result."""
    rows = docs.drop("score")
    names, at = rows.columns, rows.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        scorer = kept(("toxicity", key), lambda: _Scorer(shared.value))
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                score = scorer.m.probability(scorer.worst(part.column(at).to_pylist()).astype(float))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], [*names, "score"])

    return rows.mapInArrow(run, with_fields(rows, "score double"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = model_for(docs, labels)
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (in_fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is under 0.5, with the columns of `docs`."""
    model = model_for(docs, labels)
    return scored(docs, model).where("score < 0.5").select(docs.columns)
