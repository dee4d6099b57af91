"""Chat formatting: a finite-state machine over roles and a declarative template.

A conversation's turns are read in order, one after another, so neither the
turns nor the output of a conversation are ever held together. The machine
checks each turn's role against the state; the template gives the segments of
the turn's text, each with its loss flag. Control characters inside texts are
escaped with a backslash, so marks are found again without doubt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import table

#: Segments of a turn: literal marks, and {role} and {text}, which are escaped.
#: A segment carries loss if its flag is set and the role is one of `loss_roles`.
TEMPLATE = {
    "segments": [("### ", False), ("{role}", False), (":\n", False), ("{text}", True), ("</turn>\n", False)],
    "loss_roles": ["assistant"],
    "escape": "\\",
    "control": "#<:",
}
#: The roles that may follow each state; the state after a turn is its role.
TRANSITIONS = {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]}
TURN = "conv_id long, position long, role string, valid boolean, segments array<struct<text:string,loss:boolean>>"


def escaped(text: str, template: dict = TEMPLATE) -> str:
    mark = template["escape"]
    text = text.replace(mark, mark + mark)
    for c in template["control"]:
        text = text.replace(c, mark + c)
    return text


def unescaped(text: str, template: dict = TEMPLATE) -> str:
    mark, out, at = template["escape"], [], 0
    while (i := text.find(mark, at)) >= 0:
        out += (text[at:i], text[i + 1 : i + 2])
        at = i + 2
    return "".join([*out, text[at:]])


def formatted(turns: DataFrame, template: dict = TEMPLATE, transitions: dict = TRANSITIONS) -> DataFrame:
    """One row per turn, in order within its conversation: conv_id, position
    (from 0), role, valid (this turn and all before it kept the order of roles),
    segments. Turns go by `turn`, null ones first; ties and repeated rows by
    role and text. Null texts and roles count as empty. Turns with a null
    conv_id make one conversation. Other columns play no part. Invalid
    conversations are formatted all the same, with valid false."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, position, valid, first = None, "start", 0, True, True
        for batch in batches:
            rows = []
            for c, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if first or c != conv:
                    conv, state, position, valid, first = c, "start", 0, True, False
                valid = valid and role in transitions.get(state, ())
                state = role
                fill = {"{role}": escaped(role, template), "{text}": escaped(text, template)}
                segments = [{"text": fill.get(s, s), "loss": flag and role in template["loss_roles"]} for s, flag in template["segments"]]
                rows.append({"conv_id": c, "position": position, "role": role, "valid": valid, "segments": segments})
                position += 1
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema(
        {
            "conv_id": pa.int64(), "position": pa.int64(), "role": pa.string(), "valid": pa.bool_(),
            "segments": pa.list_(pa.struct({"text": pa.string(), "loss": pa.bool_()})),
        }
    )
    empty = F.lit("")
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text")
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, TURN)


class _Reader:
    """Digests of one conversation, read back from its formatted text."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.valid = True

    def add(self, segments: list[dict], valid: bool, template: dict) -> None:
        output = "".join(s["text"] for s in segments)
        role, text = parsed(output, template)
        self.turns.update(f"{role}\n{text}\n".encode())
        self.n += 1
        self.chars += len(output)
        masked = unescaped("".join(s["text"] for s in segments if s["loss"]), template)
        self.loss.update(masked.encode())
        self.loss_chars += len(masked)
        self.valid = valid

    def row(self, conv) -> dict:
        return {
            "conv_id": conv, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars, "valid": self.valid,
        }


def parsed(output: str, template: dict = TEMPLATE) -> tuple[str, str]:
    """Role and text of one formatted turn, found by its unescaped marks."""
    found, at, parts = {}, 0, [s for s, _ in template["segments"]]
    for k, part in enumerate(parts):
        if part not in ("{role}", "{text}"):
            if not output.startswith(part, at):
                raise ValueError(f"no {part!r} at {at}")
            at += len(part)
            continue
        end, mark = at, parts[k + 1]
        while not output.startswith(mark, end):
            end += 2 if output[end] == template["escape"] else 1
            if output[end : end + 1] not in (template["escape"], mark[0]):  # on to the next character that can matter
                ahead = [i for c in (template["escape"], mark[0]) if (i := output.find(c, end)) >= 0]
                if not ahead:
                    raise ValueError(f"no {mark!r} after {at}")
                end = min(ahead)
        found[part] = unescaped(output[at:end], template)
        at = end
    return found["{role}"], found["{text}"]


def read_back(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Digests per conversation, from the rows of `formatted`, which keep their
    partitions and order as no shuffle comes in between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, reader = None, None
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                if reader is None or x["conv_id"] != conv:
                    if reader is not None:
                        rows.append(reader.row(conv))
                    conv, reader = x["conv_id"], _Reader()
                reader.add(x["segments"], x["valid"], template)
            yield pa.RecordBatch.from_pylist(rows, schema)
        if reader is not None:
            yield pa.RecordBatch.from_pylist([reader.row(conv)], schema)

    schema = pa.schema(
        {
            "conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(),
            "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "valid": pa.bool_(),
        }
    )
    return turns.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    )


#: A conversation whose texts hold the template's own marks.
PROBE = "\\### Assistant: </turn> ok"


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], turns.schema)
    return read_back(formatted(turns.unionByName(probe)))
