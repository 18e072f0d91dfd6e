"""Operator 2: shards by jump consistent hashing.

The shard follows from a stable key and the number of shards alone: no table of the ring is kept,
and one more shard takes rows only into itself. Null keys share the hash of null; repeated rows go
to the same shard and get slots of their own; an empty table gives no rows; input columns called
shard, slot or grown_shard are replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import whole_row
from plumbline.operators.order import global_index

STEP = np.uint64(2862933555777941757)  # fixed value of the published function


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, for all keys at once."""
    state = keys.astype(np.uint64)
    shard, following = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    while (going := following < shards).any():
        shard[going] = following[going]
        state[going] = state[going] * STEP + np.uint64(1)
        draw = (state[going] >> np.uint64(33)).astype(np.float64) + 1
        following[going] = ((shard[going] + 1) * (float(1 << 31) / draw)).astype(np.int64)
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """Shard number from 0 of a key of any type."""

    @F.pandas_udf("int")
    def jump(hashed: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in hashed:
            yield pd.Series(jump_hash(part.to_numpy().view(np.uint64), shards).astype("int32"))

    return jump(F.xxhash64(key))


def shard(docs: DataFrame, key: str = "doc_id", shards: int = 16) -> DataFrame:
    """Adds shard, slot (gapless from 0, by key) and grown_shard (with one shard more).

    The rows are sorted by shard and key through one range partitioning and written once, so each
    shard is a run of neighbouring files; hot shards and repeated keys spread over tasks.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    kept = docs.drop("shard", "slot", "grown_shard")
    k = F.col(f"`{key}`")
    placed = kept.select(
        whole_row(kept).alias("row"), k.alias("key"), shard_of(k, shards).alias("shard"), shard_of(k, shards + 1).alias("grown_shard")
    )
    ordered = global_index(placed, ["shard", "key"], "index")
    first = ordered.groupBy("shard").agg(F.min("index").alias("first"))  # a row per shard
    joined = ordered.join(F.broadcast(first), "shard")
    return joined.select("row.*", "shard", (F.col("index") - F.col("first")).alias("slot"), "grown_shard")
