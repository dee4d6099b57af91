"""SentencePiece encoding and decoding with the tokenizers library.

The model file's protobuf is read here field by field; from it come the
normaliser, the metaspace marker, the pieces with their scores (unigram models)
or the merges those scores imply (BPE models), and the byte fallback. Texts are
encoded in batches on several threads. Where no piece reaches over the start of
a word, words are encoded one by one, and a worker keeps the ids of those it has
met. Every row is decoded again, and its ids are compared with those of the
sentencepiece library itself.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tracelake.llm.common import kept, slices, table, with_fields

MARK = "▁"
#: Piece types of the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Bytes given to the library at once (or one text), which bounds the memory of a batch.
BATCH_BYTES = 1 << 20
#: Words whose ids a worker keeps at most.
KEPT_WORDS = 600_000
#: Threads that encode a batch in one task.
THREADS = 2


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
            yield tag >> 3, data[at : at + size]
            at += size


def parse(data: bytes) -> Model:
    """The model's protobuf; field numbers are those of the public format."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model.kind = v
                elif n == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.add_dummy_prefix = bool(v)
                elif n == 4:
                    model.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    model.escape_whitespaces = bool(v)
    return model


class Codec:
    """Encodes and decodes like the model's own library."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.model = parse(f.read())
        self.path = path
        self.tokenizer = self._built()

    def _merges(self, ids: dict[str, int]) -> list[tuple[str, str]]:
        """Each way to put a piece together from two others, best score first."""
        out = []
        for piece, score, kind in self.model.pieces:
            if kind == NORMAL and len(piece) > 1:
                for cut in range(1, len(piece)):
                    a, b = piece[:cut], piece[cut:]
                    if a in ids and b in ids:
                        out.append((-score, ids[a], ids[b], a, b))
        out.sort()
        return [(a, b) for _, _, _, a, b in out]

    def _built(self):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        m = self.model
        unknown = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), None)
        if m.kind == BPE:
            usable = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER_DEFINED)}
            model = models.BPE(
                {p: i for i, (p, _, _) in enumerate(m.pieces)}, self._merges(usable), fuse_unk=True, cache_capacity=50_000,
                unk_token=m.pieces[unknown][0] if unknown is not None else None, byte_fallback=m.byte_fallback,
            )
        elif m.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in m.pieces], unknown, byte_fallback=m.byte_fallback)
        else:
            raise ValueError(f"model type {m.kind} is neither unigram nor BPE")
        tokenizer = Tokenizer(model)
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.remove_extra_whitespaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if m.escape_whitespaces:
            steps.append(normalizers.Replace(" ", MARK))
        if m.add_dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        tokenizer.normalizer = normalizers.Sequence(steps)
        # No piece has the marker after another character, so none reaches over
        # the start of a run of markers: words are encoded one by one.
        self.by_word = all(MARK not in p.lstrip(MARK) for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED))
        if self.by_word:
            tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
        # The normaliser only puts markers for spaces and before a text: words can be told apart before it.
        self.plain = self.by_word and m.escape_whitespaces and m.add_dummy_prefix and not m.charsmap and not m.remove_extra_whitespaces
        steps = [decoders.ByteFallback(), decoders.Fuse(), decoders.Metaspace(MARK, "never")]
        if m.add_dummy_prefix:
            steps.append(decoders.Strip(" ", 1, 0))
        tokenizer.decoder = decoders.Sequence(steps)
        return tokenizer

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids if t else [] for t, e in zip(texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True)]

    def encoded(self, texts: list[str]) -> pa.ListArray:
        if self.plain:
            return self.words.encoded(texts)
        found = self.encode(texts)
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1]))))

    @staticmethod
    def lists(ids: pa.ListArray) -> list[list[int]]:
        flat, ends = ids.values.to_numpy().tolist(), ids.offsets.to_numpy().tolist()
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    @cached_property
    def words(self) -> WordIds:
        return WordIds(self)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    @cached_property
    def library(self):
        """The model in the sentencepiece library."""
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.path)

    def same(self, texts: list[str], ids: list[list[int]]) -> list[bool]:
        """Whether the sentencepiece library gives each text these ids."""
        return [a == b for a, b in zip(ids, self.library.encode(texts, num_threads=1), strict=True)]


class WordIds:
    """Texts word by word: a word is a run of spaces and what follows it up to
    the next one. Ids of words are kept from batch to batch."""

    def __init__(self, codec: Codec):
        self.codec = codec
        #: by id, whether its piece starts with a marker
        self.begins = np.array([p.startswith(MARK) for p, _, _ in codec.model.pieces])
        self.reset()

    def reset(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.ends, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), 0

    def _learn(self, new: list[bytes]) -> None:
        """Words with one space before them are encoded as texts of many words;
        a piece that starts with a marker is then a word's first."""
        new.sort(key=lambda w: w[1:2] in (b" ", b""))
        usual = next((i for i, w in enumerate(new) if w[1:2] in (b" ", b"")), len(new))
        step = max(1, usual // 64 + 1)
        texts = [b"".join(new[i : min(i + step, usual)])[1:].decode() for i in range(0, usual, step)]
        flat = np.fromiter(chain.from_iterable(self.codec.encode(texts)), np.int32)
        sizes = np.diff(np.append(np.flatnonzero(self.begins[flat]), len(flat)))
        rest = [self.codec.encode([w[1:].decode()])[0] if w.strip(b" ") else [t.id for t in self.codec.tokenizer.model.tokenize(MARK * len(w))] for w in new[usual:]]
        flat = np.append(flat, np.array(list(chain.from_iterable(rest)), np.int32))
        sizes = np.append(sizes, np.array([len(x) for x in rest], np.int64))
        known, ends = len(self.number), self.used + np.cumsum(sizes)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        while known + len(new) >= len(self.ends):
            self.ends = np.resize(self.ends, 2 * len(self.ends))
        self.ids[self.used : self.used + len(flat)] = flat
        self.ends[known + 1 : known + 1 + len(new)] = ends
        self.used += len(flat)
        self.number.update(zip(new, range(known, known + len(new)), strict=True))

    def encoded(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text; none for an empty one."""
        joined = pa.array([f" {t}" if t else "" for t in texts], pa.large_string())
        joined = pc.replace_substring(joined, MARK, " ")  # to the normaliser they are the same
        edges = np.frombuffer(joined.buffers()[1], np.int64)[: len(texts) + 1]
        data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[: edges[-1]]
        space = data == 32
        space[1:] &= ~space[:-1]  # the first of a run
        space[edges[:-1][edges[:-1] < edges[1:]]] = True  # a text's first word, after one that ends in spaces
        starts = np.flatnonzero(space)
        ends = np.append(starts, len(data)).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.number) > KEPT_WORDS:
            self.reset()
        new = [w for w in distinct if w not in self.number]
        if new:
            self._learn(new)
        word = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        first, size = self.ends[word], self.ends[word + 1] - self.ends[word]
        upto = np.cumsum(size)
        at = np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(first - (upto - size), size)
        of_text = np.append(0, upto)[np.searchsorted(starts, edges)]
        return pa.ListArray.from_arrays(pa.array(of_text.astype(np.int32)), pa.array(self.ids[at]))


def new_codec(path: str) -> Codec:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    return Codec(path)


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return new_codec(path)


def encoded(docs: DataFrame, model: str | None = None, text: str = "text", check: bool = False, compare: bool = False) -> DataFrame:
    """`docs` with two more columns: ids (array<int>) and n_tokens (long), which
    replace columns of these names. No begin or end tokens; strings that look
    like special tokens are ordinary text. A null text counts as an empty one,
    which has no tokens. Rows, repeats and other columns stay as they are; an
    empty table gives an empty result. With `check`, a column round_trip tells
    whether the decoder gives the text again from the ids; with `compare`, a
    column same_ids tells whether the sentencepiece library gives these ids."""
    path = model or default_model()
    extra = ["ids", "n_tokens", *["round_trip"] * check, *["same_ids"] * compare]
    rows = docs.drop(*extra)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = kept(("codec", path), lambda: new_codec(path))
        for batch in batches:
            for part in slices(batch, names.index(text), BATCH_BYTES):
                texts = [t or "" for t in part.column(names.index(text)).to_pylist()]
                ids = of.encoded(texts)
                found = of.lists(ids) if check or compare else []
                new = [ids, ids.value_lengths().cast(pa.int64())]
                if check:
                    new.append(pa.array([a == b for a, b in zip(texts, of.decode(found), strict=True)], pa.bool_()))
                if compare:
                    new.append(pa.array(of.same(texts, found), pa.bool_()))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*names, *extra])

    return rows.mapInArrow(run, with_fields(rows, "ids array<int>, n_tokens long" + ", round_trip boolean" * check + ", same_ids boolean" * compare))


def decoded(rows: DataFrame, model: str | None = None, ids: str = "ids") -> DataFrame:
    """`rows` with a column `decoded`, the text of the ids; null ids: null."""
    path = model or default_model()
    rows = rows.drop("decoded")
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = kept(("codec", path), lambda: new_codec(path))
        for batch in batches:
            for part in slices(batch, names.index(ids), BATCH_BYTES // 4):
                found = part.column(names.index(ids)).to_pylist()
                texts = of.decode([x or [] for x in found])
                texts = pa.array([None if x is None else t for x, t in zip(found, texts, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*names, "decoded"])

    return rows.mapInArrow(run, with_fields(rows, "decoded string"))


def parity(texts: list[str], model: str | None = None) -> list[int]:
    """Places of the texts that the sentencepiece library encodes otherwise."""
    of = codec(model or default_model())
    return [i for i, same in enumerate(of.same(texts, of.encode(texts))) if not same]


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip (the decoded ids are the text again) and
    same_ids (those of the sentencepiece library)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, check=True, compare=True).select("doc_id", "n_tokens", "ids", "round_trip", "same_ids")
