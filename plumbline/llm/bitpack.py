"""Operator 3: token ids in files of fixed-width bits.

A file holds the documents of one range of doc_id, in ascending order: blocks of a fixed number of
ids, each id in the fewest bits that hold the vocabulary, then the offsets of the blocks, the
documents and where they start, and a footer. Blocks are read and unpacked alone, with numpy.

Tasks write files under names of their own and report them; the list of files is a Spark table, so
only files of tasks that Spark committed are read, and a lost executor leaves at most a file that
nothing refers to. Files go through pyarrow's file systems, by the URI of the shared folder.

Null text is empty and holds only the end id; rows with a null doc_id come first; repeated rows are
written once each, equal ids in any order; an empty table gives no files; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SLICE, small_batches, stored, text_of
from plumbline.llm.wordbpe import encoder

MAGIC = b"IDBITS01"
FOOTER = struct.Struct("<QQQQII8s")  # ids, documents, blocks, index offset, bits, block size, magic
BLOCK = 1 << 16


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after another, `bits` each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(spread[:, :bits], bitorder="little").tobytes()


def unpack_bits(packed: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(packed, f"<u{bits // 8}", n).astype("<u4")
    spread = np.unpackbits(np.frombuffer(packed, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    padded = np.zeros((n, 32), np.uint8)
    padded[:, :bits] = spread
    return np.packbits(padded, axis=1, bitorder="little").view("<u4").ravel()


class IdWriter:
    """Writes documents to an open binary stream; memory holds a block and the document index."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.pending, self.waiting = [], 0
        self.n_ids, self.at = 0, out.write(MAGIC)
        self.offsets, self.doc_ids, self.known, self.starts = [], [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"an id needs more than {self.bits} bits")
        self.doc_ids.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.starts.append(self.n_ids)
        self.n_ids += len(ids)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            self._flush(False)

    def _flush(self, end: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, "<u4")
        whole = len(ids) if end else len(ids) // self.block * self.block
        for i in range(0, whole, self.block):
            self.offsets.append(self.at)
            self.at += self.out.write(pack_bits(ids[i : min(i + self.block, whole)], self.bits))
        self.pending, self.waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        index = self.at
        for values, kind in ((self.offsets, "<u8"), (self.doc_ids, "<i8"), (self.known, "u1"), (self.starts, "<u8")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(FOOTER.pack(self.n_ids, len(self.doc_ids), len(self.offsets), index, self.bits, self.block, MAGIC))


class IdReader:
    """Random access to one file: documents, or any run of ids."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - FOOTER.size)
        self.n_ids, docs, blocks, index, self.bits, self.block, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        source.seek(index)
        self.offsets, self.doc_ids, self.known, self.starts = (
            np.frombuffer(source.read(n * np.dtype(kind).itemsize), kind)
            for n, kind in ((blocks, "<u8"), (docs, "<i8"), (docs, "u1"), (docs, "<u8"))
        )
        self.last: tuple[int, np.ndarray | None] = (-1, None)

    def _block(self, i: int) -> np.ndarray:
        if self.last[0] != i:
            n = min(self.block, self.n_ids - i * self.block)
            self.source.seek(int(self.offsets[i]))
            self.last = (i, unpack_bits(self.source.read((n * self.bits + 7) // 8), n, self.bits))
        return self.last[1]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from `start` to `stop`, counted within the file."""
        parts = [
            self._block(i)[max(0, start - i * self.block) : stop - i * self.block]
            for i in range(start // self.block, -(-stop // self.block) if stop > start else start // self.block)
        ]
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start within the file and ids of each document."""
        ends = [*self.starts[1:].tolist(), self.n_ids]
        for doc_id, known, start, end in zip(self.doc_ids.tolist(), self.known, self.starts.tolist(), ends):
            yield (doc_id if known else None), start, self.ids(start, end)


def write_ids(docs: DataFrame, folder: str, vocabulary: str, vocabulary_size: int, end_id: int) -> list[dict]:
    """Writes all documents in ascending doc_id; returns the files in that order.

    One entry per file: file, first id of all before it, documents, ids. Range partitioning keeps
    equal doc_ids apart by their input partition, so repeated rows spread too.
    """
    bits = max(1, int(vocabulary_size - 1).bit_length())
    end = np.array([end_id], "<u4").tobytes()
    by = ["doc_id", "__origin"]
    spark = docs.sparkSession
    ordered = (
        docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text"), F.spark_partition_id().alias("__origin"))
        .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by)
        .sortWithinPartitions(*by)
        .drop("__origin")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer = encoder(vocabulary).encode_all, None
        system, path = fs.FileSystem.from_uri(folder)
        name = f"{path}/{uuid.uuid4().hex}.bits"
        for batch in small_batches(batches, SLICE):
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encode(batch["text"])):
                if writer is None:
                    system.create_dir(path, recursive=True)
                    writer = IdWriter(system.open_output_stream(name), bits)
                writer.add(doc_id, np.frombuffer(ids + end, "<u4"))
        if writer is not None:
            writer.close()
            writer.out.close()
            row = {"piece": [TaskContext.get().partitionId()], "file": [name.rpartition("/")[2]]}
            yield pa.record_batch(row | {"n_docs": [len(writer.doc_ids)], "n_ids": [writer.n_ids]})

    files = stored(ordered.mapInArrow(write, "piece bigint, file string, n_docs bigint, n_ids bigint"))
    found = [r.asDict() for r in files.orderBy("piece").collect()]  # one row per task
    starts = accumulate((r["n_ids"] for r in found), initial=0)
    return [{"file": f"{folder}/{r['file']}", "first": s, "n_docs": r["n_docs"], "n_ids": r["n_ids"]} for r, s in zip(found, starts)]


def open_ids(file: str) -> IdReader:
    """A reader of one file, by its URI or path."""
    system, path = fs.FileSystem.from_uri(file)
    source = system.open_input_file(path)
    return IdReader(source, source.size())


def read_ids(spark, files: list[dict]) -> DataFrame:
    """All documents of the files: doc_id, start among all ids, ids (little-endian unsigned 32 bits)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first in zip(batch["file"].to_pylist(), batch["first"].to_pylist()):
                rows, held = [], 0
                for doc_id, start, ids in open_ids(file).documents():
                    rows.append((doc_id, first + start, ids.tobytes()))
                    held += len(rows[-1][2]) + 64
                    if held > 8 << 20:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    kinds = "doc_id bigint, start bigint, ids binary"
    if not files:
        return spark.createDataFrame([], kinds)
    listed = spark.createDataFrame([(f["file"], f["first"]) for f in files], "file string, first bigint")
    return listed.repartition(len(files)).mapInArrow(read, kinds)
