"""Fuzzy search for short license notices.

A notice of n letters may be met with k edits. Cut into k + 1 pieces, at least
one piece of it is then intact (pigeonhole), so exact search for the pieces
finds every candidate place. Around each, every run of whole words that begins
and ends where k edits allow is verified by the regex library's bounded-error
matching, which gives its edits. Numbers (versions) must be intact. Of spans of
a notice that overlap, that with the fewest edits stays, then the first, then
the shortest. Notices of the base list are also counted exactly, at every place.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import UPPER, table

LOWER = str.maketrans(UPPER, UPPER.lower())
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Counted exactly, at all places (fixed values).
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Notice, label, most edits. Each is long enough for its pieces to be rare.
NOTICES = (
    ("under the mit license", "mit", 2),
    ("spdx license identifier mit", "mit", 2),
    ("apache license version 2", "apache-2", 2),
    ("spdx license identifier apache 2", "apache-2", 3),
    ("cc by nc", "cc-by-nc", 0),
    ("creative commons attribution noncommercial", "cc-by-nc", 4),
    ("creative commons attribution sharealike", "cc-by-sa", 4),
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("mozilla public license", "mpl", 2),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("permission is hereby granted free of charge to any person", "mit", 5),
    ("released into the public domain", "public-domain", 3),
    ("all rights reserved", "all-rights-reserved", 1),
)


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice cut into edits + 1 pieces of nearly equal length, with their offsets."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, notices=NOTICES, base=BASE):
        self.notices = [*notices, *((p, label, 0) for p, label in base if p not in [n[0] for n in notices])]
        self.base = dict(base)
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (notice, _, edits) in enumerate(self.notices):
            for offset, piece in pieces(notice, edits):
                seeds.setdefault(piece, []).append((k, offset))
        self.seeds = ahocorasick.Automaton()
        for piece, at in seeds.items():
            self.seeds.add_word(piece, (len(piece), at))
        self.seeds.make_automaton()
        #: by notice, a pattern for each number of edits from none
        self.fuzzy = [[regex.compile(f"(?:{regex.escape(n)}){{e<={i}}}") for i in range(e + 1)] for n, _, e in self.notices]

    def edits_of(self, k: int, text: str) -> int | None:
        """Edits that turn the text into notice k; None beyond its bound, or if its numbers differ."""
        notice, _, edits = self.notices[k]
        if text == notice:
            return 0
        if not edits or abs(len(text) - len(notice)) > edits or not self.fuzzy[k][edits].fullmatch(text) or self._numbers(text) != self._numbers(notice):
            return None
        return next(i for i in range(1, edits + 1) if i == edits or self.fuzzy[k][i].fullmatch(text))

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in a text of words with single spaces, in order."""
        found: dict[tuple[int, int, int], int | None] = {}
        for last, (size, at) in self.seeds.iter(text):
            for k, offset in at:
                notice, _, edits = self.notices[k]
                start = last + 1 - size - offset
                end = start + len(notice)
                if self._whole(text, start, end) and text.startswith(notice, start):
                    found[k, start, end] = 0
                elif edits:
                    # whole words around the piece, as far as the edits allow
                    ends = [i for i in range(max(last + 1, end - edits), min(end + edits, len(text)) + 1) if i == len(text) or text[i] == " "]
                    for s in range(max(0, start - edits), min(last + 1 - size, start + edits) + 1) if ends else ():
                        if s and text[s - 1] != " ":
                            continue
                        for e in ends:
                            if (k, s, e) not in found:
                                found[k, s, e] = self.edits_of(k, text[s:e])
        taken: list[list[tuple[int, int, int]]] = [[] for _ in self.notices]
        for edits, start, end, k in sorted((n, s, e, k) for (k, s, e), n in found.items() if n is not None):
            held = taken[k]  # in order, none over another
            i = bisect.bisect_left(held, (start,))
            if (i == 0 or held[i - 1][1] <= start) and (i == len(held) or end <= held[i][0]):
                held.insert(i, (start, end, edits))
        return sorted(((k, *x) for k, held in enumerate(taken) for x in held), key=lambda x: (x[1], x[0]))

    @staticmethod
    def _whole(text: str, start: int, end: int) -> bool:
        return 0 <= start and end <= len(text) and (start == 0 or text[start - 1] == " ") and (end == len(text) or text[end] == " ")

    @staticmethod
    def _numbers(text: str) -> list[str]:
        return re.findall(r"\d+", text)

    def scan(self, text: str | None) -> dict:
        words = WORD.findall((text or "").translate(LOWER))
        joined = " ".join(words)
        spans = self.spans(joined)
        row = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "spans": []}
        if not spans:
            return row
        ends = np.cumsum([len(w) + 1 for w in words])
        base, labels, places, best = set(), set(), [], 0.0
        for k, start, end, edits in spans:
            notice, label, _ = self.notices[k]
            labels.add(label)
            best = max(best, 1 - edits / len(notice))
            first = int(np.searchsorted(ends, start, "right"))
            row["spans"].append({"label": label, "first_word": first, "end_word": int(np.searchsorted(ends, end, "left")) + 1, "edits": edits})
            if notice in self.base and not edits:
                base.add(label)
                places.append(first)
        if places:
            row |= {"n_base": len(places), "first_word": min(places), "last_word": max(places)}
        return row | {"base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": best}


@lru_cache(maxsize=4)
def scanner(notices=NOTICES, base=BASE) -> Scanner:
    return Scanner(notices, base)


def scanned(docs: DataFrame, notices=NOTICES, base=BASE) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_base, first_word, last_word
    (words of exact base notices), base_labels, labels, score (1 less the share
    of edits of the best notice; 0 without one), spans (label, first_word,
    end_word past the last, edits). A null text counts as empty: no words, no
    labels. Repeated rows and null ids each give a row; other columns play no part."""
    schema = pa.schema(
        {
            "doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
            "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(),
            "spans": pa.list_(pa.struct({"label": pa.string(), "first_word": pa.int64(), "end_word": pa.int64(), "edits": pa.int32()})),
        }
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scanner(notices, base)
        for batch in batches:
            rows = [{"doc_id": d.as_py(), **of.scan(t.as_py())} for d, t in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label:string,first_word:long,end_word:long,edits:int>>",
    )


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents")).drop("spans")
