"""Operator 10: document fingerprints as invertible Bloom lookup sketches.

A document is the multiset of its paragraphs: lines, cut at the ends of sentences and after every 16
words of a longer one, and for texts under 64 words the single words as well. Each digest goes into three cells, which hold a count, the XOR of
digests and the XOR of their checks. Subtracting two sketches leaves the digests in which the versions
differ; cells with one digest give it away and peeling recovers the rest. If peeling gets stuck, both
sides make a sketch four times as large and try again; beyond the largest size the sets of digests are
compared themselves. The likeness is the number of paragraphs in
common over the number in either.

Null text is empty; empty texts have no paragraph and are alike with likeness 1; documents follow each
other by doc_id (null first), equal ones by the hash of their texts; repeated rows follow each other;
a table of one row is its own next document; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches, text_of

SMALL = 16
LARGEST = 1 << 20
SHORT_WORDS = 64
RUN_WORDS = 16
MIX, CHECK = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
WORD = (1 << 64) - 1
PARAGRAPH = re.compile(r"[^\n]+?(?:[.!?](?= )|(?=\n)|\Z)")


def digests(text: str) -> list[int]:
    """Distinct 64-bit digests: a paragraph's n-th copy has a digest of its own."""
    units = []
    for unit in PARAGRAPH.findall(text):
        if unit.count(" ") < RUN_WORDS:
            units.append(unit)
        else:
            parts = unit.split()
            units += [" ".join(parts[i : i + RUN_WORDS]) for i in range(0, len(parts), RUN_WORDS)]
    words = text.split(None, SHORT_WORDS)
    if len(words) < SHORT_WORDS:
        units += ["\x00" + w for w in words]
    seen: Counter = Counter()
    found = []
    for unit in units:
        unit = unit.strip(" ")
        if unit:
            found.append(xxhash.xxh64_intdigest(unit, seen[unit]))
            seen[unit] += 1
    return list(dict.fromkeys(found))


class Sketch:
    """Three tables of `size` cells; `total` digests went in."""

    __slots__ = ("size", "total", "counts", "sums")

    def __init__(self, size: int, total: int, counts: list[int], sums: list[int]):
        self.size, self.total, self.counts, self.sums = size, total, counts, sums

    @classmethod
    def of(cls, keys: list[int], size: int = SMALL) -> Sketch:
        counts, sums = [0] * (3 * size), [0] * (3 * size)
        mask = size - 1
        for key in keys:
            x = ((key ^ size) * MIX) & WORD
            value = key | ((key * CHECK & WORD) >> 32) << 64
            for cell in (x >> 43 & mask, size + (x >> 22 & mask), 2 * size + (x >> 1 & mask)):
                counts[cell] += 1
                sums[cell] ^= value
        return cls(size, len(keys), counts, sums)

    def text(self) -> str:
        """The sketch as letters: total, size and the cells."""
        cells = b"".join(struct.pack("<i12s", n, s.to_bytes(12, "little")) for n, s in zip(self.counts, self.sums))
        return base64.b64encode(struct.pack("<II", self.total, self.size) + cells).decode()

    @classmethod
    def read(cls, text: str) -> Sketch:
        raw = base64.b64decode(text)
        total, size = struct.unpack_from("<II", raw)
        cells = list(struct.iter_unpack("<i12s", raw[8:]))
        return cls(size, total, [n for n, _ in cells], [int.from_bytes(s, "little") for _, s in cells])


def difference(a: Sketch, b: Sketch) -> tuple[list[int], list[int]] | None:
    """Digests only in `a` and only in `b`, or None if peeling gets stuck."""
    size, mask = a.size, a.size - 1
    counts = [x - y for x, y in zip(a.counts, b.counts)]
    sums = [x ^ y for x, y in zip(a.sums, b.sums)]
    ready = [i for i, n in enumerate(counts) if n == 1 or n == -1]
    only: tuple[list[int], list[int]] = ([], [])
    while ready:
        at = ready.pop()
        n, value = counts[at], sums[at]
        key = value & WORD
        if n not in (1, -1) or value >> 64 != (key * CHECK & WORD) >> 32:
            continue
        only[n < 0].append(key)
        x = ((key ^ size) * MIX) & WORD
        for cell in (x >> 43 & mask, size + (x >> 22 & mask), 2 * size + (x >> 1 & mask)):
            counts[cell] -= n
            sums[cell] ^= value
            if counts[cell] in (1, -1):
                ready.append(cell)
    return None if any(counts) or any(sums) else only


def likeness(a: Sketch, b: Sketch, larger: Callable[[int], tuple[Sketch, Sketch]] | None = None) -> float | None:
    """Share of paragraphs in common, from the sketches.

    `larger(size)` makes both sketches anew; sizes that cannot hold the difference of the totals are
    passed over. None if the sketches differ too much and there is no larger one.
    """
    while True:
        only = difference(a, b) if 3 * a.size >= abs(a.total - b.total) else None
        if only is not None:
            differing = len(only[0]) + len(only[1])
            common = (a.total + b.total - differing) / 2
            return common / (common + differing) if common + differing else 1.0
        if larger is None or a.size >= LARGEST:
            return None
        size = 4 * a.size
        while 3 * size < abs(a.total - b.total) and size < LARGEST:
            size *= 4
        a, b = larger(size)


class Document:
    """A text with its digests and the sketches made of them so far."""

    __slots__ = ("doc_id", "text", "keys", "small")

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.keys = digests(text)
        self.small = Sketch.of(self.keys)

    def like(self, other: Document) -> float:
        """Likeness of the two; where the largest sketches get stuck, from the digests themselves."""

        def larger(size: int) -> tuple[Sketch, Sketch]:
            return Sketch.of(self.keys, size), Sketch.of(other.keys, size)

        found = likeness(self.small, other.small, larger)
        if found is None:
            common = len({*self.keys} & {*other.keys})
            found = common / (len(self.keys) + len(other.keys) - common)
        return found

    def row(self, following: Document) -> tuple:
        cut = len(self.text) // 4
        edited = Document(None, self.text[: len(self.text) - cut] + following.text[:cut])
        return (
            self.doc_id, len(self.text), hashlib.sha256(edited.text.encode()).hexdigest(), self.small.text(),
            edited.small.text(), self.like(edited), self.like(following),
        )


RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
KINDS = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), RESULT)], schema=RESULT)


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of all documents of a sorted partition but the last one."""
    before = None
    for batch in small_batches(batches, 4 << 20):
        rows = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            now = Document(doc_id, text)
            if before is not None:
                rows.append(before.row(now))
            before = now
        if rows:
            yield _emit(rows)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last document of a sorted partition."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            if first is None:
                first = batch.slice(0, 1)
            last = batch.slice(batch.num_rows - 1, 1)
    if first is not None:
        columns = {"piece": pa.array([TaskContext.get().partitionId()], pa.int64()), "first_text": first["text"]}
        yield pa.record_batch(columns | {"last_id": last["doc_id"], "last_text": last["text"]})


def _outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the last documents, with the text that follows."""
    for batch in small_batches(batches, 4 << 20):
        rows = [
            Document(doc_id, text).row(Document(None, following))
            for doc_id, text, following in zip(*(batch[c].to_pylist() for c in ("last_id", "last_text", "next_text")))
        ]
        if rows:
            yield _emit(rows)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every document, of its edited text, and the likeness to that and to the next one.

    Documents are range-partitioned by doc_id once. Within a partition the next document is the next
    row; the few rows at the edges of partitions, one per partition, are completed apart.
    """
    spark = docs.sparkSession
    by = ["doc_id", "__hash", "__origin"]
    keyed = docs.select(
        F.col("doc_id").cast("bigint"), text_of().alias("text"), F.xxhash64(text_of()).alias("__hash"),
        F.spark_partition_id().alias("__origin"),
    )
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(pieces, *by).sortWithinPartitions(*by).select("doc_id", "text")
    edges = ordered.mapInArrow(_edges, "piece bigint, first_text string, last_id bigint, last_text string")
    line = Window.orderBy("piece")  # a row per partition
    wrapped = F.first("first_text").over(line.rowsBetween(Window.unboundedPreceding, 0))
    following = edges.withColumn("next_text", F.coalesce(F.lead("first_text").over(line), wrapped))
    return ordered.mapInArrow(_inner, KINDS).unionByName(following.mapInArrow(_outer, KINDS))
