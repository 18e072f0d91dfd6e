"""Operator 11: hard negatives by integer products in a residue number system.

Scores are inner products of integer vectors and must be exact. So the vectors are taken modulo several
primes below 256, centred round zero. The residues are multiplied as float32 matrices, in slabs of so
few dimensions that every sum stays a whole number below 2 ** 24 and is exact. Chinese remaindering
puts the residues of each score together again; there are as many primes as the largest possible score
needs, so any 64-bit components give exact scores.

Rows are dealt evenly into blocks of a bounded number of components by a hash, so no label is a hot
key. Each block is met by all anchors in turn, in slices, as they stream past the block's rows:

1. Per block and label, the best rows of the anchor's own label; over all blocks they give an anchor's
   positives, a bounded number.
2. Per block, for each positive of an anchor, the best rows of other labels within its window; over all
   blocks they give the negatives. Only these bounded lists are ranked by a Spark window.

A row takes no part if its label or vector is null or a component is null or not finite. Missing
trailing components count as zero. Rows that share the anchor's id are its own; repeated anchors give
repeated results; repeated rows of another id are candidates each; rows without id are no anchors, and
come last among ties. Components and scores beyond 64 bits become the nearest 64-bit integer. An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import stored
from plumbline.llm.impact import quantised

BLOCK_COMPONENTS = 1 << 19  # of the rows of a block
ANCHORS = 256  # multiplied with a block at once
FLOAT_EXACT = 1 << 24  # whole numbers up to here are exact in float32, as are sums of them
LARGEST = (1 << 63) - 1
PRIMES = [p for p in range(251, 2, -1) if all(p % q for q in takewhile(lambda q: q * q <= p, range(2, p)))]


class Residues:
    """Integer vectors, a row each, and their centred residues modulo small primes."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.largest = max(int(vectors.max()), -int(vectors.min())) if vectors.size else 0
        self.kept: dict[int, np.ndarray] = {}

    def modulo(self, p: int) -> np.ndarray:
        if p not in self.kept:
            r = self.vectors % p
            self.kept[p] = np.where(r > p // 2, r - p, r).astype(np.float32)
        return self.kept[p]


def product(a: Residues, b: Residues) -> np.ndarray:
    """Exact inner products of all rows of `a` with all rows of `b`, the nearest 64-bit integers."""
    dims = a.vectors.shape[1]
    bound = dims * a.largest * b.largest
    whole = np.int64 if bound < 1 << 61 else object
    total, modulus = np.zeros((len(a.vectors), len(b.vectors)), whole), 1
    for p in PRIMES:
        if modulus > 2 * bound:
            break
        left, right = a.modulo(p), b.modulo(p)
        slab = FLOAT_EXACT // (p // 2) ** 2
        found = np.zeros(total.shape, np.int64)
        for at in range(0, dims, slab):
            found += (left[:, at : at + slab] @ right[:, at : at + slab].T).astype(np.int64)
        # total + modulus * step has the residues so far, and that of p if step makes up the difference
        step = (found - (total % p).astype(np.int64)) % p * pow(modulus, -1, p) % p
        total += step.astype(whole) * modulus
        modulus *= p
    else:
        if modulus <= 2 * bound:
            raise ValueError("too few primes for these vectors")
    total = np.where(total > modulus // 2, total - modulus, total)
    return total if whole is np.int64 else np.clip(total, -LARGEST, LARGEST).astype(np.int64)


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest allowed scores of each row, ties to the smaller column; rows in order."""
    n = scores.shape[1]
    if not n or not allowed.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if max(int(scores.max()), -int(scores.min())) < LARGEST // (4 * n):
        key = np.where(allowed, scores * -n + np.arange(n), LARGEST)  # lowest first
        columns = np.argpartition(key, k - 1, axis=1)[:, :k] if k < n else np.broadcast_to(np.arange(n), scores.shape)
    else:
        order = np.lexsort((np.broadcast_to(np.arange(n), scores.shape), ~scores, ~allowed), axis=1)
        columns = order[:, :k]
    rows = np.repeat(np.arange(len(scores)), columns.shape[1])
    columns = columns.ravel()
    kept = allowed[rows, columns]
    rows, columns = rows[kept], columns[kept]
    order = np.lexsort((columns, ~scores[rows, columns], rows))
    return rows[order], columns[order]


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of a matrix, filled up with zeros."""
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values, and whether they are known."""
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


class Block:
    """Rows of one block, by id with those without id last, so the smaller column wins a tie."""

    def __init__(self, rows: pa.Table, width: int):
        table = rows.combine_chunks()
        self.ids = table["vec_id"].chunk(0)
        self.id, self.known = _numbers(self.ids)
        self.label = table["label"].chunk(0).to_numpy()
        self.residues = Residues(_vectors(table["vector"].chunk(0), width))

    def others(self, anchors: pa.RecordBatch) -> np.ndarray:
        return ~(self.known & (self.id == anchors["vec_id"].to_numpy()[:, None]))

    def same_label(self, anchors: pa.RecordBatch) -> np.ndarray:
        return self.label == anchors["label"].to_numpy()[:, None]


def _positives(block: Block, anchors: pa.RecordBatch, width: int, k: int, share: tuple[int, int]) -> dict:
    """The block's best rows of each anchor's label."""
    scores = product(Residues(_vectors(anchors["vector"], width)), block.residues)
    a, r = best(scores, block.others(anchors) & block.same_label(anchors), k)
    return {"anchor": anchors["at"].take(pa.array(a)), "positive_id": block.ids.take(pa.array(r)), "score": pa.array(scores[a, r])}


def _negatives(block: Block, anchors: pa.RecordBatch, width: int, k: int, share: tuple[int, int]) -> dict:
    """The block's best rows of other labels in the window of each positive of each anchor."""
    scores = product(Residues(_vectors(anchors["vector"], width)), block.residues)
    allowed = block.others(anchors) & ~block.same_label(anchors)
    low, whole = share
    lists = anchors["positives"].to_pylist()
    found = []
    for place in range(max(map(len, lists), default=0)):
        has = np.array([i for i, p in enumerate(lists) if len(p) > place])
        high = np.array([lists[i][place]["score"] for i in has])
        least = np.array([min(-(-low * int(s) // whole), LARGEST) for s in high])  # low * s <= whole * negative
        within = allowed[has] & (scores[has] >= least[:, None]) & (scores[has] <= high[:, None])
        a, r = best(scores[has], within, k)
        found.append((has[a], np.full(len(a), place), r))
    a, place, r = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
    return {
        "anchor": anchors["at"].take(pa.array(a)), "place": pa.array(place, pa.int32()),
        "negative_id": block.ids.take(pa.array(r)), "score": pa.array(scores[a, r]),
    }


def _meet(rows: DataFrame, anchors: DataFrame, blocks: int, width: int, by_label: bool, search, kinds: str, *args) -> DataFrame:
    """Lets all anchors stream past each block of rows, or past the block's rows of their label.

    A row is shuffled once, an anchor once per block.
    """
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = rows.select("*", F.pmod(F.xxhash64("at"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"))
    asking = anchors.select("*", each.alias("block"), F.lit(True).alias("asks"))
    by = ["block", *["label"] * by_label]
    order = [*by, "asks", F.col("vec_id").asc_nulls_last(), "at"]
    met = dealt.unionByName(asking, allowMissingColumns=True).repartition("block").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pending, block = None, [], None
        for batch in batches:
            keys = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in [*by, "asks"]], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for i, j in zip(cuts, cuts[1:]):
                key, part = tuple(keys[i, :-1]), batch.slice(i, j - i)
                if key != current:
                    current, pending, block = key, [], None
                if not keys[i, -1]:
                    pending.append(part)
                    continue
                if pending:
                    block, pending = Block(pa.Table.from_batches(pending), width), []
                for at in range(0, part.num_rows if block else 0, ANCHORS):
                    some = pa.record_batch(search(block, part.slice(at, ANCHORS), width, *args))
                    if some.num_rows:
                        yield some

    return met.mapInArrow(run, kinds)


def mine(
    vectors: DataFrame, scale: int = 256, every: int = 100, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100)
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of usable rows of `vectors`.

    Anchors are the rows whose vec_id is divisible by `every`, their positives the best rows of their
    label, and the negatives of a positive the best rows of other labels with
    share[0] * positive score <= share[1] * negative score <= share[1] * positive score.
    """
    part = vectors.select(
        F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), quantised(F.col("embedding"), scale).alias("vector")
    )
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull()
    rows = stored(part.filter(usable).withColumn("at", F.monotonically_increasing_id()))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    width = width or 0
    blocks = max(1, -(-n * max(width, 1) // BLOCK_COMPONENTS))
    anchors = rows.filter(F.col("vec_id") % every == 0)

    found = _meet(rows, anchors, blocks, width, True, _positives, "anchor bigint, positive_id bigint, score bigint", positives, share)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.col("positive_id").asc_nulls_last())
    ranked = found.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < positives)
    one = F.struct("place", "score", "positive_id")
    lists = ranked.groupBy(F.col("anchor").alias("at")).agg(F.sort_array(F.collect_list(one)).alias("positives"))
    asking = stored(anchors.join(lists, "at"))

    kinds = "anchor bigint, place int, negative_id bigint, score bigint"
    found = _meet(rows, asking, blocks, width, False, _negatives, kinds, negatives, share)
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.col("negative_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    of_anchor = asking.select(F.col("at").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.inline("positives"))
    pairs = of_anchor.withColumnRenamed("score", "positive_score")
    return ranked.withColumnRenamed("score", "negative_score").join(pairs, ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
