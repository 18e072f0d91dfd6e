"""Operator 6: exact top-k inner products by an impact-ordered index, a score at a time.

Rows are dealt into blocks. A block's index holds, per dimension, posting segments of the rows whose
component falls into one quantised level. A query takes the segments of all dimensions by descending
impact, that is by how much a segment can raise a score above the lowest one of its dimension, and
adds it up per row. It stops only when the bound of all rows but a few lies below a score that k rows
are known to reach; those few are scored exactly. Every block of queries meets every block of rows in
a task of its own, and the k best of each block are ranked together.

Vectors that are null, or hold a null or non-finite component, take no part; missing trailing
components count as zero; rows that share the query's id are its own; repeated rows of another id are
candidates each; rows with a null id are candidates ranked last among ties; scores beyond 64 bits
become the nearest 64-bit integer; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import stored

BLOCK = 8192
QUERIES = 512
LEVEL_BITS = 5
SEGMENTS = 48  # taken between two tests of the stopping rule
EXACT = 1 << 52


class ImpactIndex:
    """Posting segments of one block of integer vectors."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        n, dims = vectors.shape
        levels = (vectors >> LEVEL_BITS).T  # a row per dimension
        order = np.argsort(levels, axis=1, kind="stable")
        ranked = np.take_along_axis(levels, order, 1)
        new = np.ones((dims, n), bool)
        new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
        self.rows = order.ravel()
        self.start = np.flatnonzero(new.ravel())
        self.end = np.append(self.start[1:], dims * n)
        self.dim = self.start // max(n, 1)
        self.low = ranked.ravel()[self.start] << LEVEL_BITS
        self.high = self.low + (1 << LEVEL_BITS) - 1

    def top(self, query: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the k best allowed ones, at least those, with exact scores."""
        n = len(self.vectors)
        if allowed.sum() <= k:
            rows = np.flatnonzero(allowed)
            return rows, self.vectors[rows] @ query
        q = query[self.dim]
        most = np.maximum(q * self.low, q * self.high)
        floor = np.full(len(query), np.iinfo(np.int64).max)
        np.minimum.at(floor, self.dim, most)
        excess = most - floor[self.dim]
        taken = np.argsort(-excess, kind="stable")
        taken = taken[excess[taken] > 0]  # the others raise nothing
        bound = np.where(allowed, float(floor.sum()), -np.inf)
        rest = np.zeros(len(query))  # what the segments not taken yet can still add, per dimension
        np.maximum.at(rest, self.dim, excess)
        following = np.zeros(len(excess))  # the next lower excess of the segment's dimension
        by_dim = np.lexsort((-excess, self.dim))
        same = self.dim[by_dim][1:] == self.dim[by_dim][:-1]
        following[by_dim[:-1][same]] = excess[by_dim[1:][same]]
        for at in range(0, len(taken), SEGMENTS):
            now = taken[at : at + SEGMENTS]
            sizes = self.end[now] - self.start[now]
            place = np.repeat(self.start[now] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            bound += np.bincount(self.rows[place], np.repeat(excess[now], sizes).astype(float), n)
            np.minimum.at(rest, self.dim[now], following[now])
            leading = np.argpartition(-bound, k - 1)[:k]
            proven = (self.vectors[leading] @ query).min()  # k allowed rows reach it
            possible = bound + rest.sum() >= proven
            if possible.sum() <= 4 * k:
                break
        else:
            leading = np.argpartition(-bound, k - 1)[:k]
            possible = bound >= (self.vectors[leading] @ query).min()
        rows = np.flatnonzero(possible)
        return rows, self.vectors[rows] @ query


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for row, values in zip(out, column):
        row[: len(values)] = values
    return out


def _search(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of one block for each query of one block."""
    found = []
    if len(queries) and len(rows):
        width = max(map(len, [*queries["vector"], *rows["vector"]]))
        ids = rows["vec_id"].astype("Int64")
        known = ids.notna().to_numpy()
        numbers = ids.fillna(0).to_numpy(np.int64)
        vectors, asked = _matrix(rows["vector"], width), _matrix(queries["vector"], width)
        largest = [int(max(abs(int(m.min(initial=0))), abs(int(m.max(initial=0))))) for m in (vectors, asked)]
        exact = (largest[0] + (1 << LEVEL_BITS)) * largest[1] * max(width, 1) < EXACT
        index = ImpactIndex(vectors) if exact and width else None
        for query_id, query in zip(queries["vec_id"].to_numpy(np.int64), asked):
            allowed = ~(known & (numbers == query_id))
            if index is not None:
                at, scores = index.top(query, allowed, k)
            else:
                at = np.flatnonzero(allowed)
                whole = vectors[at].astype(object) @ query.astype(object) if width else np.zeros(len(at), object)
                scores = np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in whole], np.int64)
            best = np.lexsort((numbers[at], ~known[at], -scores))[:k]
            found += [(query_id, i, known_id, s) for i, known_id, s in zip(numbers[at[best]], known[at[best]], scores[best])]
    table = pd.DataFrame(found, columns=["query_id", "vec_id", "known", "score"])
    table["vec_id"] = table["vec_id"].astype("Int64").where(table["known"].astype(bool))
    return table[["query_id", "vec_id", "score"]].astype({"query_id": "int64", "score": "int64"})


def quantised(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null if a component is null or not finite."""
    usable = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))
    return F.when(usable, whole)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row whose vec_id is divisible by `every`."""
    part = vectors.select(F.col("vec_id").cast("bigint"), quantised(F.col("embedding"), scale).alias("vector"))
    rows = stored(part.filter(F.col("vector").isNotNull()).withColumn("at", F.monotonically_increasing_id()))
    asking = F.col("vec_id") % every == 0
    n, asked = rows.agg(F.count(F.lit(1)), F.count(F.when(asking, 1))).first()
    row_blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-asked // QUERIES))
    dealt = lambda blocks: F.pmod(F.xxhash64("at"), F.lit(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    of_rows = rows.select("vec_id", "vector", dealt(row_blocks).alias("block"), each(query_blocks).alias("queries"))
    of_queries = rows.filter(asking).select("vec_id", "vector", dealt(query_blocks).alias("queries"), each(row_blocks).alias("block"))
    keys = ["block", "queries"]
    found = of_queries.groupBy(*keys).cogroup(of_rows.groupBy(*keys)).applyInPandas(
        lambda queries, block: _search(queries, block, k), "query_id bigint, vec_id bigint, score bigint"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
