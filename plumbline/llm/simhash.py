"""Operator 5: near copies by SimHash and a self-join of the binary trie of fingerprints.

Fingerprints are first reduced to distinct ones. Two of them that differ in at most `budget` bits agree
in one whole block of bits if the 64 bits are cut into `budget` + 1 blocks. So the trie is built once
per block, over the bits rotated to begin with that block, and only pairs that agree there are followed:
each fingerprint is dealt `budget` + 1 times, however many there are. Each trie is cut into leaves of a
few thousand fingerprints, one task each; a bounded sample places the cuts. Only where the cuts go
deeper than the block, in dense places, do two leaves meet whose prefixes differ in few enough bits.

In a task the pairs of nodes are traversed from the top: each step goes to the pairs of children, adds
the bit in which they differ and drops pairs beyond the budget. A task returns a spanning forest of the
links it found, not the links, so a dense group costs no more than its size; components over all
forests follow.

Null and empty texts have the fingerprint zero and link like any other; texts under `k` words are one
shingle; repeated rows have one fingerprint; a null doc_id gets a component but never names one that
has another id; an empty table gives no rows; other columns are not read, and all kept by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches, stored, text_of, whole_row
from plumbline.llm.components import smallest_reachable

BITS = 64
LEAF = 4096
MAX_LEAVES = 16_384
PER_LEAF_SAMPLE = 16
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
CHUNK = 1 << 16


def fingerprint(text: str, k: int = 3) -> int:
    """The SimHash of the lower-cased text's shingles of `k` words."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - k + 1)
    spans = zip(starts, ends[k - 1 :] if len(words) > k else [len(joined)])
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), ">u8", n)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, CHUNK):
        counts += np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, text_hash (of the whole text) and fp (the fingerprint's bits as a signed integer)."""
    fields = [pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            bits = np.array([fingerprint(t, k) for t in batch["text"].to_pylist()], np.uint64).view(np.int64)
            columns = [batch["doc_id"], batch["text_hash"], pa.array(bits, fields[2])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "fp"])

    texts = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint")


def trie_links(
    a: np.ndarray, b: np.ndarray, budget: int, same: bool, block: int = 0
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) with a[i] and b[j] at most `budget` bits apart, none of them in the first `block`.

    Each pair is found once, also if a is b. Both are sorted and distinct. A node is a range of places that share the bits above `bit`. Pairs
    of nodes are taken in portions, deepest first, so memory holds a few portions per level.
    """
    if not len(a) or not len(b):
        return
    stack = [(BITS - 1, *(np.array([x]) for x in (0, len(a), 0, len(b), 0)))]
    while stack:
        bit, al, ah, bl, bh, off = stack.pop()
        small = (ah - al) * (bh - bl) <= 16
        if small.any() or bit < 0:
            done = small | (bit < 0)
            na, nb = (ah - al)[done], (bh - bl)[done]
            n = na * nb
            pair = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            i, j = al[done][pair] + at // nb[pair], bl[done][pair] + at % nb[pair]
            differing = a[i] ^ b[j]
            near = np.bitwise_count(differing) <= budget
            if block:
                near &= differing >> np.uint64(BITS - block) == 0
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
            al, ah, bl, bh, off = (x[~done] for x in (al, ah, bl, bh, off))
        if not len(al):
            continue
        one, above = np.uint64(1 << bit), np.uint64((1 << 64) - (1 << (bit + 1)))
        am = np.clip(np.searchsorted(a, (a[al] & above) | one), al, ah)
        bm = np.clip(np.searchsorted(b, (b[bl] & above) | one), bl, bh)
        twin = (al == bl) if same else np.zeros(len(al), bool)
        children = [(al, am, bl, bm, off, None), (am, ah, bm, bh, off, None)]
        if bit < BITS - block:
            children += [(al, am, bm, bh, off + 1, None), (am, ah, bl, bm, off + 1, twin)]
        parts = []
        for cal, cah, cbl, cbh, coff, mirrored in children:
            live = (cal < cah) & (cbl < cbh) & (coff <= budget)
            if mirrored is not None:
                live &= ~mirrored
            parts.append([x[live] for x in (cal, cah, cbl, cbh, coff)])
        merged = [np.concatenate(x) for x in zip(*parts)]
        for i in range(0, len(merged[0]), 4 * CHUNK):
            stack.append((bit - 1, *(x[i : i + 4 * CHUNK] for x in merged)))


def join_roots(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the trees of i and j; parent stays flat, each root the smallest of its tree."""
    while True:
        i, j = parent[i], parent[j]
        apart = i != j
        if not apart.any():
            return parent
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def cut_trie(sample: np.ndarray, per_leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """First value and depth of each leaf of a trie whose leaves hold at most `per_leaf` of the sample."""
    sample = np.sort(sample)
    leaves, stack = [], [(0, 0, 0, len(sample))]
    while stack:
        start, depth, low, high = stack.pop()
        if high - low <= per_leaf or depth == BITS:
            leaves.append((start, depth))
            continue
        middle = start | (1 << (BITS - 1 - depth))
        cut = low + int(np.searchsorted(sample[low:high], np.uint64(middle)))
        stack += [(middle, depth + 1, cut, high), (start, depth + 1, low, cut)]
    return np.array([s for s, _ in leaves], np.uint64), np.array([d for _, d in leaves], np.int64)


def near_leaves(starts: np.ndarray, depths: np.ndarray, budget: int, block: int) -> np.ndarray:
    """Pairs of leaves, p <= q, whose common prefixes agree in the first `block` bits and differ in `budget` at most."""
    found = [np.stack([np.arange(len(starts))] * 2, axis=1)]
    for p in np.flatnonzero(depths > block):
        q = np.arange(p + 1, len(starts))
        shared = np.minimum(depths[p], depths[q])
        differing = (starts[p] ^ starts[q]) >> np.minimum(BITS - shared, BITS - 1).astype(np.uint64)
        same = (starts[p] ^ starts[q]) >> np.uint64(BITS - block) == 0 if block else True
        q = q[(np.bitwise_count(differing) <= budget) & same]
        found.append(np.stack([np.full(len(q), p), q], axis=1))
    return np.concatenate(found)


def rotated(x: np.ndarray, by: int) -> np.ndarray:
    """Bits moved up by `by` places, those that leave at the top come in below."""
    return x if by % BITS == 0 else (x << np.uint64(by % BITS)) | (x >> np.uint64(BITS - by % BITS))


def link_forest(distinct: DataFrame, n: int, budget: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` that connect exactly the linked ones."""
    leaves = int(min(MAX_LEAVES, max(1, n // LEAF)))
    sample = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(PER_LEAF_SAMPLE * leaves)  # n / 256 at most
    values = np.array([r["fp"] for r in sample.collect()], np.int64).view(np.uint64)
    ends = [BITS * (j + 1) // (budget + 1) for j in range(budget + 1)]
    tries, pairs = [], []  # one of each per block; pairs are numbered through
    for begin, end in zip([0, *ends], ends):
        starts, depths = cut_trie(rotated(values, begin), PER_LEAF_SAMPLE if leaves > 1 else len(values))
        meeting = near_leaves(starts, depths, budget, end - begin)
        apart = np.flatnonzero(meeting[:, 0] != meeting[:, 1])
        leaf = np.concatenate([meeting[:, 0], meeting[apart, 1]])
        number = np.concatenate([np.arange(len(meeting)), apart]) + sum(map(len, pairs))
        order = np.argsort(leaf, kind="stable")
        first = np.searchsorted(leaf[order], np.arange(len(starts) + 1))
        tries.append((begin, end - begin, starts, number[order], first))
        pairs.append(np.column_stack([np.full(len(meeting), len(pairs)), meeting]))
    every = np.concatenate(pairs)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            fp = whole["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            for begin, _, starts, of_leaf, first in tries:
                turned = rotated(fp, begin)
                leaf = np.searchsorted(starts, turned, "right") - 1
                n_pairs = first[leaf + 1] - first[leaf]
                place = np.arange(n_pairs.sum()) - np.repeat(np.cumsum(n_pairs) - n_pairs, n_pairs)
                pair = of_leaf[np.repeat(first[leaf], n_pairs) + place]
                dealt = np.repeat(turned, n_pairs).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(dealt)], names=["pair", "fp"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        trie, p, q = every[group["pair"].iat[0]]
        begin, block, starts, _, _ = tries[trie]
        fp = np.sort(group["fp"].to_numpy().view(np.uint64))
        parent = np.arange(len(fp))
        if p == q:
            for i, j in trie_links(fp, fp, budget, True, block):
                parent = join_roots(parent, i, j)
        else:
            leaf = np.searchsorted(starts, fp, "right") - 1
            left, right = np.flatnonzero(leaf == p), np.flatnonzero(leaf == q)
            for i, j in trie_links(fp[left], fp[right], budget, False, block):
                parent = join_roots(parent, left[i], right[j])
        child = np.flatnonzero(parent != np.arange(len(fp)))
        ends = [rotated(fp[x], BITS - begin).view(np.int64) for x in (child, parent[child])]
        return pd.DataFrame({"a": ends[0], "b": ends[1]})

    return distinct.select("fp").mapInArrow(deal, "pair bigint, fp bigint").groupBy("pair").applyInPandas(join, "a bigint, b bigint")


def _classes(prints: DataFrame, budget: int) -> DataFrame:
    """fp, the first (no id, doc_id, text_hash) that has it, and the root of its component."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    distinct = stored(prints.groupBy("fp").agg(first.alias("first")))
    roots = smallest_reachable(link_forest(distinct, distinct.count(), budget)).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def components(docs: DataFrame, k: int = 3, budget: int = 2) -> DataFrame:
    """doc_id, text_hash, fp and component_id, the smallest doc_id reachable over links."""
    prints = stored(fingerprints(docs, k))
    classes = _classes(prints, budget)
    smallest = classes.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    of_print = classes.join(smallest, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "text_hash", "fp", "component_id")


def keep_one(docs: DataFrame, k: int = 3, budget: int = 2) -> DataFrame:
    """One row of each component: that of its smallest doc_id, then text hash; all columns are kept."""
    classes = _classes(stored(fingerprints(docs, k)), budget)
    kept = classes.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_hash")
    hashed = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(text_of()).alias("hash"))
    same = hashed["id"].eqNullSafe(kept["doc_id"]) & (hashed["hash"] == kept["text_hash"])
    once = F.row_number().over(Window.partitionBy("id", "hash").orderBy("hash"))
    return hashed.join(kept, same, "left_semi").withColumn("once", once).filter("once = 1").select("row.*")


def hex_digits(column: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
