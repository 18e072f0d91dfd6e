"""Operator 4: conversations as training text with a loss mask.

A compiled template marks the turns; control strings inside roles and texts are escaped so that they
can be read back. Rows are partitioned by conversation, sorted, and rendered one after another as
they stream by, so memory holds a message and not a conversation. A conversation's text and digests
are a sequence by nature and come from one task; very long ones are written in several parts.

Null role and text are empty; turns with equal numbers follow by role, then text; null turns come
first; rows with a null conv_id form one conversation; repeated rows are turns each; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches, text_of
from plumbline.llm.template import compiled

CONTROLS = ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]")
TURN, TEXT, END = CONTROLS[:3]
TEMPLATE = (
    "{% for message in messages %}"
    "{{ '<|turn|>' }}{{ message.role | escape }}{{ '<|text|>' }}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    "{{ '<|end|>' + '\\n' }}"
    "{% endfor %}"
)
PART = 1 << 20
ESCAPE = re.compile(r"\\|" + "|".join(f"(?<={re.escape(c[0])}){re.escape(c[1:])}" for c in CONTROLS))
UNESCAPE = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """No control string is left: a backslash stands after its first character; backslashes are doubled."""
    return ESCAPE.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, part, start, text and loss: the spans of `text` to learn, in code points from `start` 0.

    Parts of a conversation follow each other in one partition.
    """
    by = ["conv_id", "turn", "role", "text"]
    turns = conversations.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), text_of("role").alias("role"), text_of().alias("text")
    )
    ordered = turns.repartition("conv_id").sortWithinPartitions(*by)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([
        ("conv_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("text", pa.string()), ("loss", pa.list_(span)),
    ])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        render = compiled(template, {"escape": escape})
        messages = (m for batch in small_batches(batches) for m in batch.to_pylist())
        for conv_id, turns in groupby(messages, key=lambda m: m["conv_id"]):
            part, start, at, pieces, loss, held = 0, 0, 0, [], [], 0
            for text, generated in render(turns):
                pieces.append(text)
                if generated:
                    loss.append((at, at + len(text)))
                at, held = at + len(text), held + len(text)
                if held >= PART:
                    yield conv_id, part, start, "".join(pieces), loss
                    part, start, pieces, loss, held = part + 1, at, [], [], 0
            if pieces or not part:
                yield conv_id, part, start, "".join(pieces), loss

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for row in rows(batches):
            kept.append(row)
            size += len(row[3])
            if size >= 4 * PART:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)
                kept, size = [], 0
        if kept:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)

    return ordered.mapInArrow(run, "conv_id bigint, part int, start bigint, text string, loss array<struct<start: bigint, end: bigint>>")


class Reading:
    """One conversation read back from its formatted parts."""

    def __init__(self) -> None:
        self.rest, self.at, self.n_turns, self.n_chars, self.loss_chars = "", 0, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.open, self.learned = None, []

    def add(self, text: str, loss: list[dict], start: int) -> None:
        self.n_chars += len(text)
        for span in loss:
            if span["start"] != self.open:  # a span that goes on in this part is one text with the last
                self._learn()
            self.learned.append(text[span["start"] - start : span["end"] - start])
            self.open = span["end"]
        self.rest += text
        while (end := self.rest.find(END)) >= 0:
            role, _, said = self.rest[self.rest.index(TURN) + len(TURN) : end].partition(TEXT)
            self.turns.update(f"{unescape(role)}\n{unescape(said)}\n".encode())
            self.n_turns += 1
            self.rest = self.rest[end + len(END) :]

    def _learn(self) -> None:
        learned = unescape("".join(self.learned))
        self.loss_chars += len(learned)
        self.loss.update(learned.encode())
        self.learned = []

    def result(self, conv_id: int | None) -> tuple:
        self._learn()
        return conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.n_chars


def read_back(texts: DataFrame) -> DataFrame:
    """Turns and learned text of each conversation, digested, from the output of `formatted`."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (p for batch in small_batches(batches) for p in batch.to_pylist())
        found = []
        for conv_id, own in groupby(parts, key=lambda p: p["conv_id"]):
            reading = Reading()
            for p in own:
                reading.add(p["text"], p["loss"], p["start"])
            found.append(reading.result(conv_id))
            if len(found) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    return texts.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
