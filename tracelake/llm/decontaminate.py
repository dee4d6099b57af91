"""Benchmark decontamination with CGK embeddings.

The CGK random walk reads a sequence and writes, at each step, the word under
its pointer; a random bit of (step, word) moves the pointer on or keeps it. Two
sequences a few edits apart soon walk in step again, so their outputs differ at
few places: edit distance becomes Hamming distance. Words sampled at a few steps
of the walk (bit sampling) are a key; several walks with samples of their own
reach the target recall. Windows of the texts with the size of benchmark items
are looked up by key; where the whole walks differ little, the edit distance
between the item and the text around the window decides.

Windows start at every `stride`-th word of a text; an item is embedded from
`stride` words on end, so that one of its embeddings meets a window's start. The
walks begin at places spread over the words that the item has beyond its window.

Walks are likely to meet an edited item, not sure to. So an item is also cut into
one part more than it may have edits: one part at least stands unedited in any
text that holds the item, and each place with the words of a part is a candidate
as well. The edit distance decides there too, so none within EDITS is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import released, slices, table, union
from tracelake.shared import written

#: Sizes of windows in words. An item uses the largest that fits it.
SIZES = (32, 16, 12, 8, 4, 2, 1)
#: Walks per size. With edits in a tenth of the words a walk's sample is intact
#: in about half of the cases, so ten miss about one in a thousand.
WALKS = 10
#: Steps of a walk, at most; its pointer moves on at every second one.
STEPS = 16
SEED = 1
#: Share of an item's words that may be edited.
EDITS = 0.2
#: Share of the outputs of a walk over the whole window that must agree before
#: the edit distance is computed.
AGREE = 0.35
#: Bytes of item text that one pass over the documents takes.
PASS_BYTES = 8 << 20
SLICE_BYTES = 1 << 20

_K = np.uint64(0x9E3779B97F4A7C15)
_KINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []
_IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: Characters beyond ASCII that part words, and those that are words by
#: themselves, of scripts that put no spaces between words.
_PARTS = r"[^\p{L}\p{N}\p{M}\x00-\x7F]+"
_SINGLE = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"


def stride(size: int) -> int:
    return max(1, size // 4)


def sampled(size: int) -> int:
    """Words in a key."""
    return {1: 1, 2: 2, 4: 3}.get(size, 5)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters and digits, in lower case; each
    character of scripts without spaces) of all texts, each text's followed by a
    zero; and where each text's words start."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    most = np.frombuffer(texts.buffers()[2] or b"\0", np.uint8).max(initial=0)
    if most >= 0xC2:
        texts = pc.replace_substring_regex(texts, _PARTS, " ")
    if most >= 0xE0:  # those scripts' characters have three bytes or more
        texts = pc.replace_substring_regex(texts, _SINGLE, r" \1 ")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    n = len(data)
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        _POWERS[:] = [np.multiply.accumulate(np.append(np.uint64(1), np.full(size, k))) for k in (_K, _KINV)]
    is_word = np.zeros(n + 2, bool)
    is_word[1:-1] = _IS_WORD[data]
    start = np.flatnonzero(is_word[1:-1] & ~is_word[:-2])
    stop = np.flatnonzero(is_word[1:-1] & ~is_word[2:]) + 1
    # Texts that touch: a word ends and begins anew at each text's start.
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    edge = np.unique(edge[is_word[edge] & is_word[edge + 1]])
    if len(edge):
        start, stop = np.sort(np.append(start, edge)), np.sort(np.append(stop, edge))
    sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[0][:n], dtype=np.uint64))
    words = _mix((sums[stop] - sums[start]) * _POWERS[1][start]) | np.uint64(1)
    before = np.searchsorted(start, offsets)  # words before each text
    out = np.zeros(len(words) + len(texts), np.uint64)
    out[np.arange(len(words)) + np.searchsorted(offsets[1:], start, "right")] = words
    return out, before + np.arange(len(before))


def walk(words: np.ndarray, moves: np.ndarray, at: np.ndarray, size: int, number: int, wanted: set[int]) -> Iterator[np.ndarray]:
    """Outputs at the wanted steps of a walk from each start: the words under
    the pointers. Step and walk choose the bit of the word (`moves`: its upper
    half) that moves the pointer; a zero, past the end of a text, holds it."""
    bits = np.random.default_rng([size, number]).permutation(32).astype(np.uint32)
    p, bit = at.astype(np.int64), np.empty(len(at), np.uint32)
    for step in range(max(wanted) + 1):  # past 32 steps the bits come round again
        if step in wanted:
            yield words[p]
        np.take(moves, p, out=bit, mode="clip")
        bit >>= bits[step % 32]
        bit &= np.uint32(1)
        p += bit


def keys(words: np.ndarray, moves: np.ndarray, at: np.ndarray, size: int, number: int) -> np.ndarray:
    """One key per start: the words at the sampled steps of one walk."""
    steps = np.random.default_rng([size, number, SEED]).choice(min(size, STEPS), min(size, sampled(size)), replace=False)
    key = np.full(len(at), number + 1, np.uint64)
    for w in walk(words, moves, at, size, number, set(steps.tolist())):
        key ^= w
        key *= _K
        key ^= key >> np.uint64(32)
    return key


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """One key for each run of `size` words."""
    key = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        key ^= words[k : len(key) + k]
        key *= _K
        key ^= key >> np.uint64(32)
    return key


def parts_of(n: int) -> tuple[list[int], int]:
    """Where the parts of an item of n words start, one more than it may have
    edits, and the words of each that are looked up."""
    parts = int(EDITS * n) + 1
    return [k * n // parts for k in range(parts)], n // parts


def bitmap_of(keys: np.ndarray) -> np.ndarray:
    """By the upper bits of a key, whether there may be such a key."""
    bits = max(16, int(np.ceil(np.log2(len(keys)))) + 5)
    bitmap = np.zeros(1 << bits, bool)
    bitmap[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
    return bitmap


def met(key: np.ndarray, bitmap: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in `key` and in the ordered `known` with the same key."""
    hit = np.flatnonzero(bitmap[(key >> np.uint64(65 - len(bitmap).bit_length())).astype(np.int64)])
    low, high = np.searchsorted(known, key[hit]), np.searchsorted(known, key[hit], "right")
    hit, low, count_of = hit[high > low], low[high > low], (high - low)[high > low]
    return np.repeat(hit, count_of), np.repeat(low - np.append(0, np.cumsum(count_of)[:-1]), count_of) + np.arange(count_of.sum())


def moves_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(32)).astype(np.uint32)


@dataclass
class Index:
    """Keys of one block of items."""

    ids: np.ndarray
    words: np.ndarray  # all items' words, each item's followed by a zero
    moves: np.ndarray
    starts: np.ndarray
    by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # bitmap, keys in order, item, place
    parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # by words looked up: the same of the parts

    @staticmethod
    def of(ids: list[int], texts: list[str]) -> Index:
        words, starts = word_hashes(pa.array(texts, pa.string()))
        n, moves = np.diff(starts) - 1, moves_of(words)
        by_size = {}
        for rank, size in enumerate(SIZES):
            larger = SIZES[rank - 1] if rank else None
            items = np.flatnonzero((n >= size + stride(size) - 1) & (n > 0))
            if larger:
                items = items[n[items] < larger + stride(larger) - 1]
            if not len(items):
                continue
            item = np.repeat(items, stride(size))
            spare = n[item] - size - stride(size) + 1
            places = [starts[item] + spare * k // (WALKS - 1) + np.tile(np.arange(stride(size)), len(items)) for k in range(WALKS)]
            found = np.concatenate([keys(words, moves, place, size, k) for k, place in enumerate(places)])
            order = np.argsort(found, kind="stable")
            by_size[size] = (bitmap_of(found), found[order], np.tile(item, WALKS)[order], np.concatenate(places)[order])
        parts, pairs = {}, {}
        for i in np.flatnonzero(n > 0).tolist():
            begins, size = parts_of(int(n[i]))
            pairs.setdefault(size, []).extend((i, int(starts[i]) + b) for b in begins)
        for size, found in pairs.items():
            item, place = np.array(found, np.int64).T
            found = grams(words, size)[place]
            order = np.argsort(found, kind="stable")
            parts[size] = (bitmap_of(found), found[order], item[order], place[order])
        return Index(np.array(ids, np.int64), words, moves, starts, by_size, parts)

    def candidates(self, words: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(items, where they would begin) of the windows whose walk agrees with
        an item's and of the places with the words of an item's part."""
        for size, (bitmap, known, item, place) in self.parts.items():
            if len(words) >= size:
                at, entry = met(grams(words, size), bitmap, known)
                # a run that reaches into the next text has a zero, which no part has
                yield item[entry], at - (place[entry] - self.starts[item[entry]])
        moves = moves_of(words)
        for size, (bitmap, known, item, place) in self.by_size.items():
            step = stride(size)
            n = np.diff(starts) - 1
            count = -(-n // step)
            first = np.repeat(starts[:-1] - np.append(0, np.cumsum(count)[:-1]) * step, count)
            at = np.arange(int(count.sum())) * step + first
            for number in range(WALKS):
                key = keys(words, moves, at, size, number)
                hit, entry = met(key, bitmap, known)
                if not len(hit):
                    continue
                window = at[hit]
                same = np.zeros(len(window), np.int32)
                every = set(range(2 * size))
                theirs = walk(self.words, self.moves, place[entry], size, number, every)
                for a, b in zip(walk(words, moves, window, size, number, every), theirs, strict=True):
                    same += (a == b) & (a != 0)
                near = same >= AGREE * len(every)
                entry, window = entry[near], window[near]
                yield item[entry], window - (place[entry] - self.starts[item[entry]])

    def likely(self, item: int, begins: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Those of the places around which the text has enough of the item's words: each one it lacks is an edit."""
        own = self.words[self.starts[item] : self.starts[item + 1] - 1]
        most = int(EDITS * len(own))
        around, out = np.arange(-most, len(own) + most), np.zeros(len(begins), bool)
        block = max(1, (1 << 22) // (len(around) * len(own)))
        for s in range(0, len(begins), block):
            near = words[np.clip(begins[s : s + block, None] + around, 0, len(words) - 1)]
            out[s : s + block] = (near[:, :, None] == own).any(1).sum(1) >= len(own) - most
        return begins[out]

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, end word, edits): the place with the fewest
        edits (then the first) of each item in each text that holds it."""
        words, starts = word_hashes(texts)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        found = list(self.candidates(words, starts))
        if not found:
            return []
        pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)]), axis=1)
        edges = np.flatnonzero(np.diff(pairs[0], prepend=-1, append=-1)) if pairs.size else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            item = int(pairs[0, a])
            own = self.words[self.starts[item] : self.starts[item + 1] - 1]
            most = int(EDITS * len(own))
            begins = self.likely(item, pairs[1, a:b], words)
            if not len(begins):
                continue
            # places close together are looked at as one
            cuts = np.flatnonzero(np.diff(begins) > most) + 1
            for first, last in zip(begins[np.append(0, cuts)].tolist(), begins[np.append(cuts, len(begins)) - 1].tolist(), strict=True):
                # a place may reach over texts that are shorter than the edits allowed
                low = int(np.searchsorted(starts, max(first - most, 0), "right")) - 1
                for text in range(max(low, 0), int(np.searchsorted(starts, last + len(own) + most, "left"))):
                    if text >= len(starts) - 1:
                        break
                    begin = max(int(starts[text]), first - most)
                    near = words[begin : min(int(starts[text + 1]) - 1, last + len(own) + most)]
                    if len(near) < len(own) - most or np.isin(own, near).sum() < len(own) - most:
                        continue  # each word that the text lacks is an edit
                    edits, s, e = aligned(own, near)
                    if edits <= most:
                        place = (edits, begin - int(starts[text]) + s, begin - int(starts[text]) + e)
                        best[text, item] = min(best.get((text, item), place), place)
        return [(t, i, s, e, edits) for (t, i), (edits, s, e) in sorted(best.items())]


def aligned(item: np.ndarray, near: np.ndarray) -> tuple[int, int, int]:
    """Fewest word edits that turn some run of `near` into the item, and that run."""
    m = len(near)
    cost, begin, j = np.zeros(m + 1, np.int64), np.arange(m + 1), np.arange(m + 1)
    for word in item:
        swap = np.append(np.iinfo(np.int32).max, cost[:-1] + (near != word))
        drop = cost + 1
        own = np.minimum(swap, drop)
        from_swap = swap <= drop
        began = np.where(from_swap, np.append(0, begin[:-1]), begin)
        # an extra word of the text costs one: running minimum of cost - place
        packed = (own - j) * (m + 2) + (m + 1 - j)  # ties to the nearest, so that a run begins late
        best = np.minimum.accumulate(packed)
        source = m + 1 - (best % (m + 2))
        cost, begin = own[source] + (j - source), began[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, text, key): the usable items; key is the same for equal texts."""
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.distinct().withColumn("key", F.xxhash64("text"))


def _indexes(benchmark: DataFrame, pass_bytes: int) -> Iterator[Index]:
    """The distinct texts of the items in blocks of `pass_bytes` at most, on average, by their key."""
    rows = _items(benchmark).groupBy("key").agg(F.min("text").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // pass_bytes))
    for block in range(blocks):
        some = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block)
        got = some.orderBy("key").collect()
        yield Index.of([r["key"] for r in got], [r["text"] for r in got])


MATCH = "doc_id long, key long, first_word long, end_word long, edits int, item_words int"


def leaks(docs: DataFrame, benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, item_id, first_word, end_word, edits, item_words): for each row
    of `docs` and item that it holds with edits in at most EDITS of the item's
    words, the place with the fewest edits, as words of the text from
    first_word up to end_word. Words are runs of letters and digits in lower
    case; of scripts that put no spaces between words, each character. An item
    of a few words is held by every document with these words. Null texts and
    texts without words hold nothing; items that are null or without words are
    held by nothing. Repeated rows and null ids of documents each give their
    rows; of several items with the same text each gives its rows, and items
    with the same id and other texts count as one id each. Other columns play no
    part. A large benchmark is taken in passes over the documents, one after
    another: each one's finds are written before the next index is sent out."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    passes, last = [], None
    for index in _indexes(benchmark, pass_bytes):
        if last is not None:
            passes.append(written(last[0], "leaks"))
            last[1].unpersist()
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            released()
            index = shared.value
            for batch in batches:
                for part in slices(batch, 1, SLICE_BYTES):
                    ids = part.column(0).to_pylist()
                    found = index.matches(part.column(1))
                    if found:
                        yield pa.RecordBatch.from_pylist(
                            [
                                {
                                    "doc_id": ids[t], "key": int(index.ids[i]), "first_word": s, "end_word": e, "edits": edits,
                                    "item_words": int(index.starts[i + 1] - index.starts[i] - 1),
                                }
                                for t, i, s, e, edits in found
                            ],
                            schema,
                        )

        last = rows.mapInArrow(run, MATCH), shared
    found = union([*passes, last[0]])
    return found.join(_items(benchmark).select("item_id", "key"), "key").select("doc_id", "item_id", "first_word", "end_word", "edits", "item_words")


schema = pa.schema(
    {"doc_id": pa.int64(), "key": pa.int64(), "first_word": pa.int64(), "end_word": pa.int64(), "edits": pa.int32(), "item_words": pa.int32()}
)


def clean(docs: DataFrame, benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of `docs` that hold no item, all columns as they are. Of several
    passes each one's rows are written before the next."""
    names, last = docs.columns, None
    for index in _indexes(benchmark, pass_bytes):
        if last is not None:
            docs = written(docs, "clean")
            last.unpersist()
        shared = last = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            released()
            at = names.index("text")
            for batch in batches:
                for part in slices(batch, at, SLICE_BYTES):
                    held = {t for t, *_ in shared.value.matches(part.column(at))}
                    yield part.filter(pa.array([k not in held for k in range(part.num_rows)]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
