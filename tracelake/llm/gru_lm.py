"""Language-model scoring with a gated recurrent network.

1. Spark counts every token of the training documents.
2. The softmax is factored by groups of classes and by class: P(token | state) =
   P(group | state) * P(class | group, state) * P(token | class, state). The most
   frequent words, a stated number, share classes, cut where a token meets the
   fewest words, and have a softmax of their own within the class.
   All others fall into classes by their ending; within those a token has the
   probability that the counts of all training documents give it. A token never
   seen has a share in its class, as in the base.
3. Texts are encoded once, as symbols, which training and scoring read. The
   network is trained by truncated backpropagation in numpy: in rounds,
   every shard trains a copy on its documents, each of them whole and in one
   shard of one of the rounds, so that every token is trained on once; the
   copies' changes are averaged in Spark. Rounds and shards are hashes of the
   documents, in numbers that grow with the corpus, so that the same documents
   dealt otherwise train the same network.
4. Documents are scored whole, the state carried from window to window. Counts
   of rare words don't fit in a broadcast: they come by a join at the end.
"""

from __future__ import annotations

import zlib
from collections import Counter  # noqa: F401 (for the tests)
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import in_fold, kept_pages, one_thread, resized, table, with_fields
from tracelake.shared import written

#: The end of a document as a token: no word holds a line break.
END = b"\n"
#: Words with a softmax of their own, their classes, and the classes by ending.
OWN_WORDS, OWN_CLASSES, ENDING_CLASSES = 4095, 64, 128
#: Words whose counts are broadcast at most, a bound on what is sent to each worker.
BROADCAST_WORDS = 200_000
EMBED, HIDDEN = 24, 32
#: Steps of truncated backpropagation, documents side by side.
WINDOW, LANES = 16, 256
#: Tokens of a shard, on average at most.
SHARD_TOKENS = 500_000
#: Tokens after which training starts a document's state anew: runs of one length keep all lanes busy.
TRAIN_RUN = 512
RATE = 0.04
ADD = 0.1
CHUNK = 4096
#: Bytes of text that are encoded at once, bytes of symbols that are scored side by side, and tokens that training takes side by side.
TEXT_BYTES, SCORE_BYTES, TRAIN_TOKENS = 8 << 20, 8 << 20, 32 * LANES * WINDOW
#: Symbols in the encoded documents.
SYMBOL = np.dtype("<u2")
#: Logits below this need no shift before they are raised.
BOUND = 60.0
HALF = np.float32(0.5)


def tokens_of(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z only), by ASCII white space; the end isn't among them."""
    return (text or "").encode().lower().split()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of `tokens_of` of all texts, one after another, and the place of each one's text."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    split = pc.ascii_split_whitespace(texts)
    flat, text = split.flatten(), np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(flat), 0)  # an empty text gives an empty word
    if pc.all(some).as_py():
        return flat, text
    return flat.filter(some), text[some.to_numpy(zero_copy_only=False)]


def ending_class(word: bytes) -> int:
    """Class of a word without a softmax of its own: by its last three bytes."""
    return zlib.crc32(word[-3:]) % ENDING_CLASSES


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c) over all rows, counted slice by slice, then in each task, before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in resized(batches, 0, TEXT_BYTES):
            found = words_of(part.column(0))[0].value_counts()
            tokens = pa.concat_arrays([found.field("values"), pa.array([END.decode()], pa.large_string())])
            yield pa.RecordBatch.from_arrays([tokens.cast(pa.string()), pa.array([*found.field("counts").to_pylist(), part.num_rows], pa.int64())], ["token", "c"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What every worker knows of the counts."""

    n: int  # tokens
    v: int  # distinct tokens
    number: dict[bytes, int]  # of the most frequent words, by falling count; those with a softmax of their own come first
    count: np.ndarray  # by number
    symbol: np.ndarray  # by number: an own word's number, or the number of own words + the class by ending
    own: int  # words with a softmax of their own
    class_starts: np.ndarray  # of the own words
    class_mass: np.ndarray  # of the classes by ending: tokens + ADD for each distinct one and an unseen one
    log_class: np.ndarray  # log of each class's share of the tokens

    @property
    def classes(self) -> int:
        return len(self.class_starts) - 1 + ENDING_CLASSES

    @property
    def end(self) -> int:
        """Symbol of a document's end."""
        return int(self.symbol[self.number[END]]) if END in self.number else self.own + ending_class(END)


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    """From the written counts: totals over all of them, and the most frequent words."""
    totals = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = totals["n"] or 0, totals["v"]
    # The most frequent ones without a sort: counts in steps of a 32nd of a
    # power of two, as many of the highest steps as the bound allows whole, and
    # of the next one the words with the smallest hashes.
    step, share = F.floor(F.log2("c") * 32), F.pmod(F.xxhash64("token"), F.lit(1 << 20))
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("step", ascending=False)
    whole = int((sizes["n"].cumsum() <= BROADCAST_WORDS).sum())
    chosen = step >= (int(sizes["step"].iloc[whole - 1]) if whole else 1 << 20)
    if whole < len(sizes):
        room = (BROADCAST_WORDS - int(sizes["n"].iloc[:whole].sum())) / int(sizes["n"].iloc[whole])
        chosen |= (step == int(sizes["step"].iloc[whole])) & (share < int(0.98 * room * (1 << 20)))
    top = counts.where(chosen).toPandas().sort_values(["c", "token"], ascending=[False, True])
    tokens, count = [t.encode() for t in top["token"]], top["c"].to_numpy(np.int64)
    own = min(len(tokens), OWN_WORDS)
    mass, roots = np.cumsum(count[:own].astype(float)), np.cumsum(np.sqrt(count[:own]))
    # equal sums of the roots of the counts: so a token meets the fewest words of its class
    cuts = np.searchsorted(roots, np.arange(1, OWN_CLASSES) * (roots[-1] if own else 1) / OWN_CLASSES) + 1
    starts = np.unique(np.concatenate([[0], cuts[cuts < own], [own]])).astype(np.int64)
    by_ending = np.zeros((ENDING_CLASSES, 2))
    ending = F.pmod(F.crc32(F.expr("substring(cast(token AS binary), -3)")), F.lit(ENDING_CLASSES))
    for r in counts.groupBy(ending.alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("d")).collect():
        by_ending[int(r["k"])] = r["c"], r["d"]
    for w, c in zip(tokens[:own], count, strict=False):
        by_ending[ending_class(w)] -= c, 1
    class_mass = by_ending[:, 0] + ADD * (by_ending[:, 1] + 1)
    own_mass = np.diff(np.append(0.0, mass)[starts])
    share = np.concatenate([own_mass, class_mass])
    symbol = np.array([*range(own), *(own + ending_class(t) for t in tokens[own:])], np.int32)
    number = {t: i for i, t in enumerate(tokens)}
    return Vocabulary(n, v, number, count, symbol, own, starts, class_mass, np.log(share / max(share.sum(), 1e-9)).astype(np.float32))


class Lookup:
    """Numbers of words, those met in the texts after those of the vocabulary;
    by number the symbol, the count (-1: not among the broadcast ones) and the
    logarithm of the count (0 for those others: it comes by a join)."""

    def __init__(self, words: Vocabulary):
        self.words = words
        self.reset()

    def reset(self) -> None:
        known = len(self.words.number)
        self.number = self.words.number.copy()
        self.symbol, self.count = np.zeros(known + BROADCAST_WORDS, np.int32), np.full(known + BROADCAST_WORDS, -1, np.int64)
        self.symbol[:known], self.count[:known] = self.words.symbol, self.words.count
        self.log_count = np.log10(np.where(self.count < 0, 1, self.count + ADD))

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        """Good until the next call, which may start anew."""
        if len(self.number) > len(self.words.number) + 2 * BROADCAST_WORDS:
            self.reset()
        number, own = self.number, self.words.own
        get = number.get
        out = np.fromiter(map(get, tokens, repeat(-1)), np.int64, len(tokens))
        for i in np.flatnonzero(out < 0).tolist():
            t = tokens[i]
            n = number.setdefault(t, len(number))
            if n == len(self.symbol):
                self.symbol, self.count = np.resize(self.symbol, 2 * n), np.append(self.count, np.full(n, -1, np.int64))
                self.log_count = np.append(self.log_count, np.zeros(n))
            self.symbol[n] = own + ending_class(t)
            out[i] = n
        return out


class Network:
    """Weights in one flat vector, with a view for each part. The gates' stand one
    after another: candidate, update, reset for the input ("x", "b"); update, reset,
    candidate for the state ("h"), so that the four of a step's gradients overlap."""

    def __init__(self, words: Vocabulary, flat: np.ndarray | None = None):
        self.words = words
        own, classes = words.own, words.classes
        #: groups of about as many neighbouring classes as there are groups
        groups = max(1, round(classes**0.5))
        self.group_starts = np.arange(groups + 1) * classes // groups
        # the last column of "group", "class" and "word" is added to every logit
        self.shapes = {
            "embed": (own + ENDING_CLASSES, EMBED), "x": (3, EMBED, HIDDEN), "h": (3, HIDDEN, HIDDEN), "b": (3, HIDDEN),
            "group": (groups, HIDDEN + 1), "class": (classes, HIDDEN + 1), "word": (own, HIDDEN + 1),
        }
        size = sum(int(np.prod(s)) for s in self.shapes.values())
        self.flat = np.zeros(size, np.float32) if flat is None else flat.astype(np.float32).copy()
        self.w = self.parts(self.flat)
        if flat is None:
            rng = np.random.default_rng(3)
            for k, scale in (("embed", 0.3), ("x", EMBED**-0.5), ("h", HIDDEN**-0.5)):
                self.w[k][:] = rng.standard_normal(self.shapes[k]) * scale
            self.w["group"][:, -1] = np.log(np.add.reduceat(np.exp(words.log_class), self.group_starts[:-1]))
            self.w["class"][:, -1] = words.log_class
            self.w["word"][:, -1] = np.log(words.count[:own])
        frequent = len(words.class_starts) - 1
        #: class of each symbol, group of each class
        self.class_of = np.append(np.repeat(np.arange(frequent), np.diff(words.class_starts)), np.arange(frequent, words.classes))
        self.group_of = np.repeat(np.arange(groups), np.diff(self.group_starts))
        #: every choice: the part of the weights, and from which of its rows to which
        pairs = lambda part, starts: [(part, a, b) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        self.choices = [("group", 0, groups), *pairs("class", self.group_starts), *pairs("word", words.class_starts)]

    def parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Views of a vector as long as the weights."""
        out, at = {}, 0
        for k, shape in self.shapes.items():
            size = int(np.prod(shape))
            out[k] = flat[at : at + size].reshape(shape)
            at += size
        return out

    def projected(self, symbols: np.ndarray) -> Iterator[np.ndarray]:
        """Inputs of the gates, step by step: (3, lanes, HIDDEN) for each row of (steps, lanes)."""
        for step in symbols:
            x = self.w["embed"].take(step, 0) @ self.w["x"]
            x += self.w["b"][:, None]
            yield x

    def states(self, proj: Iterable[np.ndarray], fresh: np.ndarray, h: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States after each step (steps, lanes), with a one after each, from the
        gates' inputs, step by step; a fresh step starts from zero."""
        steps, lanes = fresh.shape
        out, u = np.ones((steps, lanes, HIDDEN + 1), np.float32), self.w["h"]
        anew = fresh.any(1).tolist()
        hu, zr, c = (np.empty((n, lanes, HIDDEN), np.float32) for n in (3, 2, 1))
        if keep is not None:
            keep |= {k: np.empty((n, steps, lanes, HIDDEN), np.float32) for k, n in (("before", 1), ("hu", 3), ("zr", 2), ("c", 1))}
        for t, x in enumerate(proj):
            if anew[t]:
                h = h * ~fresh[t][:, None]
            if keep is not None:
                keep["before"][0, t] = h
                hu, zr, c = (keep[k][:, t] for k in ("hu", "zr", "c"))
            np.matmul(h, u, out=hu)
            # logistic, as half a tanh of the half and a half
            np.add(x[1:], hu[:2], out=zr)
            zr *= HALF
            np.tanh(zr, out=zr)
            zr *= HALF
            zr += HALF
            np.multiply(zr[1], hu[2], out=c[0])
            c += x[:1]
            np.tanh(c, out=c)
            h = h - c[0]
            h *= zr[0]
            h += c[0]
            out[t, :, :HIDDEN] = h
        return out, h

    def room(self) -> float:
        """What the logits of any state, whose parts are below 1, leave of the bound."""
        return BOUND - max(np.abs(self.w[k]).sum(1).max(initial=0) for k in ("group", "class", "word"))

    def log_probabilities(self, states: np.ndarray, symbols: np.ndarray, bounded: bool, grads: dict | None = None) -> np.ndarray:
        """Natural log P(group) * P(class | group) * P(own word | class) of each symbol after its
        state (with a one after it); for others up to the class. With `grads`, puts the gradients of
        the mean loss there, and that of the states under "states"."""
        n, classes = len(symbols), self.class_of[symbols]
        # in the order of classes, so that those who meet the same choice stand together
        order = np.argsort(classes.astype(np.uint16), kind="stable")
        symbols, classes, states = symbols[order], classes[order], states.take(order, 0)
        groups, frequent = self.group_of[classes], len(self.words.class_starts) - 1
        edges = [np.array([0, n]), np.searchsorted(classes, self.group_starts), np.searchsorted(classes, np.arange(frequent + 1))]
        # all logits in one vector, choice by choice, token by token
        runs, at = [], 0
        for (part, low, high), s, t in zip(self.choices, np.concatenate([e[:-1] for e in edges]).tolist(), np.concatenate([e[1:] for e in edges]).tolist(), strict=True):
            if s < t and high - low > 1:
                runs.append((part, low, high, s, t, at))
                at += (t - s) * (high - low)
        logits = np.empty(at, states.dtype)
        views = [logits[a : a + (t - s) * (high - low)].reshape(t - s, -1) for _, low, high, s, t, a in runs]
        for (part, low, high, s, t, _), view in zip(runs, views, strict=True):
            np.matmul(states[s:t], self.w[part][low:high].T, out=view)
        chosen = {"group": groups, "class": classes, "word": symbols}
        low, high, s, t = np.array([r[1:5] for r in runs], np.int64).reshape(-1, 4).T
        widths = np.repeat(high - low, t - s)
        starts = np.cumsum(widths) - widths
        token = np.arange(len(widths)) + np.repeat(s - np.cumsum(t - s) + (t - s), t - s)
        place = starts - np.repeat(low, t - s) + np.concatenate([chosen[r[0]][r[3] : r[4]] for r in runs] or [starts])
        if not bounded:
            logits -= np.repeat(np.maximum.reduceat(logits, starts), widths)
        picked = logits[place]
        np.exp(logits, out=logits)
        total, ones, row = np.empty(len(widths), states.dtype), np.ones(max((v.shape[1] for v in views), default=0), states.dtype), 0
        for view in views:
            np.matmul(view, ones[: view.shape[1]], out=total[row : row + len(view)])
            row += len(view)
        picked -= np.log(total)
        out = np.empty(n, states.dtype)
        out[order] = np.bincount(token, picked, n)
        if grads is not None:
            total *= n
            logits *= np.repeat(np.reciprocal(total), widths)
            logits[place] -= np.float32(1 / n)
            back = np.zeros((n, HIDDEN), states.dtype)
            for (part, low, high, s, t, _), view in zip(runs, views, strict=True):
                np.matmul(view.T, states[s:t], out=grads[part][low:high])
                back[s:t] += view @ self.w[part][low:high, :-1]
            grads["states"] = np.empty_like(back)
            grads["states"][order] = back
        return out


def lanes_of(docs: list[np.ndarray], most: int) -> list[list[int]]:
    """Documents dealt to lanes of nearly equal length, the longest first."""
    total, longest = sum(map(len, docs)), max(map(len, docs))
    n = max(1, min(most, -(-total // longest)))
    lanes, sizes = [[] for _ in range(n)], np.zeros(n, np.int64)
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        k = int(np.argmin(sizes))
        lanes[k].append(i)
        sizes[k] += len(docs[i])
    return lanes


def streams(docs: list[np.ndarray], lanes: list[list[int]], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets, fresh starts and document numbers (-1: none) as (steps, lanes)."""
    steps = max(sum(len(docs[i]) for i in lane) for lane in lanes)
    shape = (steps, len(lanes))
    inputs, targets = np.full(shape, end, np.int32), np.full(shape, end, np.int32)
    fresh, number = np.zeros(shape, bool), np.full(shape, -1, np.int32)
    for k, lane in enumerate(lanes):
        at = 0
        for i in lane:
            d = docs[i]
            targets[at : at + len(d), k] = d
            inputs[at + 1 : at + len(d), k] = d[:-1]
            fresh[at, k] = True
            number[at : at + len(d), k] = i
            at += len(d)
    return inputs, targets, fresh, number


def stepped(weights: np.ndarray, squares: np.ndarray, grad: np.ndarray) -> None:
    """An Adagrad step in place; `grad` is used up."""
    np.clip(grad, -1, 1, out=grad)
    scale = grad * grad
    squares += scale
    grad *= RATE
    np.sqrt(squares, out=scale)
    scale += 1e-4
    grad /= scale
    weights -= grad


def train_on(net: Network, docs: list[np.ndarray], end: int, squares: np.ndarray) -> int:
    """Truncated backpropagation over the documents, Adagrad steps; tokens read."""
    inputs, targets, fresh, number = streams(docs, lanes_of(docs, LANES), end)
    h, read, room, most = np.zeros((inputs.shape[1], HIDDEN), np.float32), 0, 0.0, (HIDDEN + 1) * RATE
    embed, squared = net.w["embed"], net.parts(squares)["embed"]
    for s in range(0, len(inputs), WINDOW):
        part = slice(s, s + WINDOW)
        there = number[part].ravel() >= 0
        if not there.any():
            break
        kept: dict[str, np.ndarray] = {}
        states, h = net.states(net.projected(inputs[part]), fresh[part], h, kept)
        grad = np.zeros_like(net.flat)
        grads = net.parts(grad)
        room -= most  # no step moves a logit's bound by more
        if room < 0:
            room = net.room()
        at, target = states.reshape(-1, HIDDEN + 1), targets[part].ravel()
        if there.all():
            net.log_probabilities(at, target, room >= 0, grads)
            ds = grads.pop("states")
        else:
            net.log_probabilities(at[there], target[there], room >= 0, grads)
            ds = np.zeros((there.size, HIDDEN), np.float32)
            ds[there] = grads.pop("states")
        rows, sums = back_through(net, inputs[part], fresh[part], kept, ds.reshape(*states.shape[:2], HIDDEN), grads)
        stepped(net.flat[embed.size :], squares[embed.size :], grad[embed.size :])
        some, its_squares = embed[rows], squared[rows]
        stepped(some, its_squares, sums)
        embed[rows], squared[rows] = some, its_squares
        read += int(there.sum())
    return read


def back_through(net: Network, inputs: np.ndarray, fresh: np.ndarray, kept: dict[str, np.ndarray], ds: np.ndarray, grads: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Adds the gradients of the recurrent part, given those of the states; rows of
    the embedding that took part and their gradients."""
    (before,), (c,), (z, r), hc = kept["before"], kept["c"], kept["zr"], kept["hu"][2]
    steps, lanes = fresh.shape
    u, x = (np.ascontiguousarray(net.w[k].swapaxes(1, 2)) for k in ("h", "x"))
    # All of a step is done while its arrays are near: what the loss changes at
    # candidate, update, reset, and at the candidate's share of the state before.
    each, free, one = np.empty((4, lanes, HIDDEN), np.float32), np.empty((lanes, HIDDEN), np.float32), np.ones(lanes, np.float32)
    to_c, to_z, to_r, to_h = each
    dh, through = np.zeros((lanes, HIDDEN), np.float32), np.empty((3, lanes, HIDDEN), np.float32)
    to_input, shares, anew = np.empty((steps, lanes, EMBED), np.float32), np.empty((3, lanes, EMBED), np.float32), fresh.any(1).tolist()
    for t in range(steps - 1, -1, -1):
        dh += ds[t]
        np.subtract(1, z[t], out=free)
        np.multiply(dh, free, out=to_c)
        np.subtract(before[t], c[t], out=to_z)
        to_z *= z[t]
        to_z *= to_c
        np.multiply(c[t], c[t], out=free)
        np.subtract(1, free, out=free)
        to_c *= free
        np.multiply(to_c, r[t], out=to_h)
        np.multiply(to_h, hc[t], out=to_r)
        np.subtract(1, r[t], out=free)
        to_r *= free
        grads["h"] += before[t].T @ each[1:]
        grads["x"] += net.w["embed"].take(inputs[t], 0).T @ each[:3]
        grads["b"] += one @ each[:3]
        np.matmul(each[:3], x, out=shares)
        np.add(shares[0], shares[1], out=to_input[t])
        to_input[t] += shares[2]
        np.matmul(each[1:], u, out=through)
        dh *= z[t]
        for g in through:
            dh += g
        if anew[t]:
            dh *= ~fresh[t][:, None]
    order = np.argsort(inputs.astype(np.uint16), axis=None, kind="stable")
    ins = inputs.ravel()[order]
    first = np.flatnonzero(np.append(True, ins[1:] != ins[:-1]))
    return ins[first], np.add.reduceat(to_input.reshape(-1, EMBED).take(order, 0), first)


def rounds_of(tokens: int) -> int:
    """Rounds of training: one more for each tenfold of the tokens, beyond a million."""
    return max(2, len(str(tokens)) - 5)


def dealing() -> Column:
    """Deals documents to rounds and shards."""
    return F.xxhash64("doc_id", "text")


def round_of(docs: DataFrame, number: int, rounds: int) -> DataFrame:
    """The documents of a round, with the hash that deals them to its shards."""
    if "deal" not in docs.columns:
        docs = docs.withColumn("deal", dealing())
    return docs.where(F.pmod(F.xxhash64("deal"), F.lit(rounds)) == number)


CHANGES = "chunk int, shard int, change binary, read long"


def changes_of(docs: DataFrame, shared: Broadcast, shards: int) -> DataFrame:
    """What each shard's documents, which are encoded first if they aren't, change in
    the shared network, times the tokens read, in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        kept_pages()
        words, flat = shared.value
        net, read = Network(words, flat), 0
        squares = np.full_like(net.flat, 1e-6)
        held, size = [], 0
        for batch in batches:
            for coded in batch.column(0):
                symbols = np.frombuffer(coded.as_buffer(), SYMBOL)
                held += [symbols[i : i + TRAIN_RUN] for i in range(0, len(symbols), TRAIN_RUN)]
                size += len(symbols)
                if size >= TRAIN_TOKENS:
                    read += train_on(net, held, words.end, squares)
                    held, size = [], 0
        if held:
            read += train_on(net, held, words.end, squares)
        if read:
            change = (net.flat - flat) * read
            chunks = [change[i : i + CHUNK].tobytes() for i in range(0, len(change), CHUNK)]
            n, shard = len(chunks), TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(n), pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(chunks, pa.binary()), pa.array([read] * n, pa.int64())], ["chunk", "shard", "change", "read"]
            )

    if "symbols" not in docs.columns:
        docs = encoded(docs, shared)
    # a shard's documents in an order of their own, whatever the table's is
    dealt = docs.select("deal", "doc_id", "symbols").repartition(shards, "deal").sortWithinPartitions("deal", "doc_id", "symbols")
    return dealt.select("symbols").mapInArrow(run, CHANGES)


def averaged(changes: DataFrame, shards: int) -> np.ndarray | None:
    """The mean change by the tokens read; None if there were none."""

    def added(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("shard")
        total = sum(np.frombuffer(c, np.float32).astype(np.float64) for c in f["change"])
        return pd.DataFrame({"chunk": f["chunk"].iloc[:1], "shard": f["shard"].iloc[:1], "change": [total.astype(np.float32).tobytes()], "read": [int(f["read"].sum())]})

    # In two levels, so that a group holds few of the copies, however many there are.
    groups = max(1, round(shards**0.5))
    first = changes.groupBy("chunk", F.col("shard") % groups).applyInPandas(added, CHANGES)
    total = first.groupBy("chunk").applyInPandas(added, CHANGES).orderBy("chunk").collect()
    return np.concatenate([np.frombuffer(r["change"], np.float32) for r in total]) / total[0]["read"] if total else None


def trained(docs: DataFrame, words: Vocabulary) -> np.ndarray:
    """Weights after all rounds over encoded documents."""
    rounds, flat = rounds_of(words.n), Network(words).flat
    shards = max(1, -(-words.n // (rounds * SHARD_TOKENS)))
    for number in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast((words, flat))
        change = averaged(changes_of(round_of(docs, number, rounds), shared, shards), shards)
        shared.unpersist()
        if change is not None:
            flat = flat + change
    return flat


class _Coder:
    def __init__(self, words: Vocabulary):
        self.words, self.lookup, self.log_mass = words, Lookup(words), np.log10(words.class_mass)

    def code(self, texts: pa.Array) -> dict[str, pa.Array]:
        """Per text: tokens, what the counts tell of the two scores, its rare words
        with their numbers, and its symbols. A rare word's own count is missing in both scores."""
        flat, document = words_of(texts)
        coded = flat.dictionary_encode()
        at = coded.indices.to_numpy()
        words = pa.concat_arrays([pa.array([END.decode()], pa.large_string()), coded.dictionary])
        number = self.lookup.numbers(words.cast(pa.large_binary()).to_pylist())
        symbol, count, log_count = self.lookup.symbol[number], self.lookup.count[number], self.lookup.log_count[number]
        # a document's words, then its end, which is word 0
        sizes = np.bincount(document, minlength=len(texts)) + 1
        token = np.zeros(len(at) + len(texts), np.int64)
        token[np.arange(len(at)) + document] = at + 1
        document, own = np.repeat(np.arange(len(texts)), sizes), self.words.own
        rest = np.where(symbol >= own, log_count - self.log_mass[np.maximum(symbol - own, 0)], 0.0)
        total = lambda x: np.bincount(document, x[token], len(texts))
        base = total(log_count) - sizes * np.log10(self.words.n + ADD * (self.words.v + 1))
        unknown = np.flatnonzero(count[token] < 0)
        pairs, times = np.unique(document[unknown] * len(number) + token[unknown], return_counts=True)
        ends = np.searchsorted(pairs, np.arange(len(texts) + 1) * len(number))
        rare = pa.StructArray.from_arrays([words.take(pa.array(pairs % len(number))).cast(pa.string()), pa.array(times, pa.int32())], ["token", "n"])
        places = np.append(0, np.cumsum(sizes) * SYMBOL.itemsize).astype(np.int32)
        symbols = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(places), pa.py_buffer(symbol.astype(SYMBOL)[token])])
        return {
            "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(total((count > 0).astype(float)), pa.int64(), safe=False), "base_score": pa.array(base),
            "score": pa.array(total(rest)), "rare": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare), "symbols": symbols,
        }


CODED = "n_tokens long, n_known long, base_score double, score double, rare array<struct<token:string,n:int>>, symbols binary"


def encoded(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """The documents as `_Coder` says, in place of their texts."""
    others = docs.drop("text")
    text_at = len(others.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_pages()
        coder = _Coder(shared.value[0])
        for part in resized(batches, text_at, TEXT_BYTES):
            if part.num_rows:
                found = coder.code(part.column(text_at))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *found.values()], [*part.schema.names[:-1], *found])

    return docs.select(*others.columns, "text").mapInArrow(run, with_fields(others, CODED))


class _Scorer:
    def __init__(self, words: Vocabulary, flat: np.ndarray):
        self.net, self.words, self.end = Network(words, flat), words, words.end
        self.bounded = self.net.room() >= 0
        self.table = next(self.net.projected(np.arange(len(self.net.w["embed"]))[None]))

    def score(self, texts: pa.Array) -> dict[str, pa.Array]:
        """What `_Coder` says of the texts, with whole scores but for the rare words' counts."""
        found = _Coder(self.words).code(texts)
        return {**found, "score": self.completed(found["score"], found["symbols"])}

    def completed(self, score: pa.Array, symbols: pa.Array) -> pa.Array:
        """The scores by the counts with the network's part, which the symbols give."""
        return pa.array(score.to_numpy() + self._network([np.frombuffer(x.as_buffer(), SYMBOL) for x in symbols]) / np.log(10))

    def _network(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each document, as far as the network tells."""
        inputs, targets, fresh, number = streams(docs, lanes_of(docs, LANES), self.end)
        h, sums = np.zeros((inputs.shape[1], HIDDEN), np.float32), np.zeros(len(docs))
        step = max(WINDOW, 16_384 // inputs.shape[1])
        for s in range(0, len(inputs), step):  # windows; the state goes on
            states, h = self.net.states((self.table.take(i, 1) for i in inputs[s : s + step]), fresh[s : s + step], h)
            at, states, target = number[s : s + step].ravel(), states.reshape(-1, HIDDEN + 1), targets[s : s + step].ravel()
            if at.min() < 0:
                there = at >= 0
                at, states, target = at[there], states[there], target[there]
            sums += np.bincount(at, self.net.log_probabilities(states, target, self.bounded), len(docs))
        return sums


def scored(docs: DataFrame, folds: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one
    row per row of `docs`. Documents with crc32(doc_id) divisible by `folds` are
    held out: they are scored, and teach nothing. A null text counts as empty:
    it has one token, its end. Null ids count as held out. Repeated rows each
    teach and are scored. Without training rows nothing is known and the base is
    that of one unseen token. Other columns play no part."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held_out = in_fold(F.col("doc_id"), folds) == 0
    training = rows.where(~held_out)
    counts = written(token_counts(training), "token-counts")
    words = vocabulary_of(counts)
    numbered = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text", held_out.alias("held_out"), dealing().alias("deal"))
    # Written, so that a row keeps its number if a task is run again, and each text is cut into tokens once.
    coded = written(encoded(numbered, docs.sparkSession.sparkContext.broadcast((words, None))), "encoded")
    flat = trained(coded.where(~F.col("held_out")), words)
    shared = docs.sparkSession.sparkContext.broadcast((words, flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        kept_pages()
        scorer = _Scorer(*shared.value)
        for part in resized(batches, 1, SCORE_BYTES):
            if part.num_rows:
                yield pa.RecordBatch.from_arrays([scorer.completed(*part.columns[:2]), *part.columns[2:]], ["score", *part.schema.names[2:]])

    others = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base_score"]
    partial = coded.select("score", "symbols", *others).mapInArrow(run, coded.select("score", *others).schema)
    partial = written(partial, "scored")
    rare = coded.select("uid", F.explode("rare").alias("x")).select("uid", F.col("x.token").alias("token"), F.col("x.n").alias("n"))
    met = rare.join(counts, "token", "left").select(
        "uid", (F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD))).alias("add"), F.when(F.col("c") > 0, F.col("n")).otherwise(0).cast("long").alias("n_known")
    )
    none = {"doc_id": "long", "held_out": "boolean", "n_tokens": "long", "base_score": "double", "score": "double"}
    both = partial.select("uid", F.lit(0.0).alias("add"), "n_known", *none).unionByName(met.select("uid", "add", "n_known", *[F.lit(None).cast(t).alias(k) for k, t in none.items()]))
    summed = both.groupBy("uid").agg(F.sum("add").alias("add"), F.sum("n_known").alias("n_known"), *[F.max(k).alias(k) for k in none])
    return summed.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(words.n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.col("add")).alias("base_score"), (F.col("score") + F.col("add")).alias("score"),
    )


def op5_gru_lm(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
