"""Operator 1: best-fit packing of documents into sequences by bin completion.

Documents become pieces of at most one sequence; only their lengths decide the packing. The lengths
are counted (at most `capacity` distinct ones), the counts are packed by `binpacking.plan`, and each
piece finds its place from its rank among the pieces of its length. The rank comes from the rank
within its task plus the counts of the tasks before, so no task ever gathers the pieces of a length.

Null text is empty; an empty text is one piece that holds only the end id; a null doc_id is packed
like any other; repeated rows are packed once each; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.binpacking import plan
from plumbline.llm.common import SLICE, small_batches, stored, text_of
from plumbline.llm.wordbpe import encoder

RANK_BITS = 44


def numbered_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, ids: bool = False) -> DataFrame:
    """Token pieces for `pack`: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids themselves."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * ids)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_all
        for batch in small_batches(batches, SLICE):
            rows: list[tuple] = []
            for doc_id, encoded in zip(batch["doc_id"].to_pylist(), encode(batch["text"])):
                packed = encoded + end
                for i, at in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[at : at + 4 * capacity]
                    rows.append((doc_id, i, at // 4, len(part) // 4, zlib.crc32(part)) + (part,) * ids)
            columns = zip(*rows) if rows else [[] for _ in schema]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    kinds = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * ids
    texts = docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text"))
    return texts.mapInArrow(lambda batches: _number(cut(batches)), f"{kinds}, __task int, __rank bigint")


def number(items: DataFrame) -> DataFrame:
    """Items with a `length`, made ready for `pack`."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return items.mapInArrow(_number, f"{kinds}, __task int, __rank bigint")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task and each row's rank among the rows of its length in this task."""
    task, seen = TaskContext.get().partitionId(), Counter()
    for batch in batches:
        ranks = []
        for length in batch["length"].to_pylist():
            ranks.append(seen[length])
            seen[length] += 1
        tasks = pa.array([task] * batch.num_rows, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, tasks, pa.array(ranks, pa.int64())], names=[*batch.schema.names, "__task", "__rank"]
        )


def places(bins: list[tuple[int, tuple]]) -> dict[str, np.ndarray]:
    """Ranks of each length in order of sequences: arrays with one entry per filling and length."""
    rows, sequence, taken = [], 0, Counter()
    for n, filling in bins:
        offset = 0
        for length, each in filling:
            rows.append((length, taken[length], sequence, each, offset))
            taken[length] += n * each
            offset += length * each
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    names = ("length", "rank", "sequence", "each", "offset")
    return {k: table[:, i] for i, k in enumerate(names)} | {"key": (table[:, 0] << RANK_BITS) + table[:, 1]}


def pack(items: DataFrame, capacity: int, effort: int = 40_000) -> DataFrame:
    """Adds sequence_id and offset to numbered items that have a `length` from 1 to `capacity`.

    Only the counts by length reach the driver, and the plan that goes to the tasks has an entry per
    filling and length: both are bounded by the capacity, whatever the number of rows.
    """
    numbered = stored(items)
    counts = numbered.groupBy("length", "__task").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "__task", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    sizes = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    at, names = places(plan(sizes, capacity, effort)), [c for c in items.columns if c not in ("__task", "__rank")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema if f.name in names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            i = np.searchsorted(at["key"], (length << RANK_BITS) + rank, "right") - 1
            bin_no, within = np.divmod(rank - at["rank"][i], at["each"][i])
            columns = [batch[c] for c in names]
            columns += [pa.array(at["sequence"][i] + bin_no), pa.array(at["offset"][i] + within * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    ranked = numbered.join(before, ["length", "__task"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    return ranked.drop("__before", "__task").mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack(numbered_pieces(docs, vocabulary, end_id, capacity), capacity)
