"""Exact nearest neighbours by bounding boxes, without comparing all pairs.

A tree of median cuts, made from a bounded sample, deals the points into at most `CELLS` cells; a cell
of more than a chunk's rows is cut into slices by a hash, so a chunk has the same size in any table.
The smallest box round a cell's points tells how near it can come to a query. A query first searches a
chunk of its nearest cell, which bounds the distance of its k-th neighbour, and is then sent to the
cells whose boxes come nearer than that and to no others.

Within a chunk a second tree cuts the points into leaves of a few, again with boxes of their own. All
queries of a task take their leaves in the order of the boxes' distances, best first, and each stops
when the next box is farther than the k-th neighbour found so far.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import skew
from plumbline.operators.profile import q

CHUNK_ROWS = 8192
QUERY_ROWS = 2048  # of a cell that one task answers
CELLS = 4096
SAMPLE_PER_CELL = 32
LEAF = 16
PAIR_BLOCK = 2_000_000
SLACK = 1 + 1e-9  # boxes and distances are rounded


def _vector(features: list[str]) -> Column:
    return F.array(*[q(c).cast("double") for c in features])


def split(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of the points in leaves of at most `most`, by median cuts of the widest spread."""
    leaves, todo = [], [np.arange(len(points))]
    while todo:
        places = todo.pop()
        if len(places) <= most:
            leaves.append(places)
            continue
        part = points[places]
        dim, middle = int(np.argmax(part.var(axis=0))), len(places) // 2
        order = np.argpartition(part[:, dim], middle)
        todo += [places[order[middle:]], places[order[:middle]]]
    return leaves


def cuts(sample: np.ndarray, cells: int) -> np.ndarray:
    """A tree of up to `cells` leaves: rows of (dimension, cut, below, not below); leaves are -1 - number."""
    nodes: list[list[float]] = []
    todo, leaves = [(np.arange(len(sample)), cells, None, 0)], 0
    while todo:
        places, wanted, parent, side = todo.pop(0)
        part = sample[places]
        spread = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(sample.shape[1])
        dim = int(np.argmax(spread))
        me = -1 - leaves
        if wanted > 1 and spread[dim] > 0:
            low = wanted // 2
            cut = np.sort(part[:, dim])[max(1, len(part) * low // wanted)]
            below = part[:, dim] < cut
            if below.any():
                me = len(nodes)
                nodes.append([dim, cut, 0, 0])
                todo += [(places[below], low, me, 2), (places[~below], wanted - low, me, 3)]
        if me < 0:
            leaves += 1
        if parent is not None:
            nodes[parent][side] = me
    return np.array(nodes, float).reshape(-1, 4)


def cell_of(points: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """Number of the leaf of the tree in which each point lies."""
    at = np.zeros(len(points), np.int64) if len(tree) else np.full(len(points), -1)
    while (inner := np.flatnonzero(at >= 0)).size:
        node = tree[at[inner]]
        below = points[inner, node[:, 0].astype(np.int64)] < node[:, 1]
        at[inner] = np.where(below, node[:, 2], node[:, 3]).astype(np.int64)
    return -1 - at


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box, 0 inside."""
    out = np.zeros((len(points), len(low)))
    for x, a, b in zip(points.T, low.T, high.T):
        gap = np.maximum(a - x[:, None], x[:, None] - b)
        np.maximum(gap, 0, out=gap)
        out += gap * gap
    return out


def search(
    asked: np.ndarray, bound: np.ndarray, own: np.ndarray | None, points: np.ndarray, keys: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, int]:
    """Squared distances and places of the k nearest points within each query's squared bound.

    `points` are in ascending order of their keys, which decides ties; a point whose key is in `own` at
    the query's place is left out. The third result is the number of distances computed. Places that
    are not filled have the distance inf.
    """
    leaves = split(points, LEAF)
    inside = np.full((len(leaves), max(map(len, leaves))), -1)
    for row, places in zip(inside, leaves):
        row[: len(places)] = places
    low, high = (np.stack([f(points[places], axis=0) for places in leaves]) for f in (np.min, np.max))
    best = np.full((len(asked), k), np.inf)
    place = np.full((len(asked), k), len(points))
    compared, step = 0, max(1, PAIR_BLOCK // max(len(leaves), inside.shape[1] * points.shape[1]))
    for start in range(0, len(asked), step):
        block = np.arange(start, min(start + step, len(asked)))
        away = box_distance(asked[block], low, high)
        order = np.argsort(away, axis=1)
        going = np.arange(len(block))
        for i in range(len(leaves)):
            leaf = order[going, i]
            limit = np.minimum(bound[block[going]], best[block[going], -1])
            live = away[going, leaf] <= limit * SLACK
            going, leaf = going[live], leaf[live]
            if not len(going):
                break
            rows, inner = block[going], inside[leaf]
            d2 = ((asked[rows][:, None, :] - points[inner]) ** 2).sum(axis=2)
            compared += int((inner >= 0).sum())
            d2[inner < 0] = np.inf
            if own is not None:
                d2[keys[inner] == own[rows][:, None]] = np.inf
            better = (d2 <= best[rows, -1:]).any(axis=1)
            rows, d2, inner = rows[better], d2[better], inner[better]
            found, where = np.concatenate([best[rows], d2], axis=1), np.concatenate([place[rows], inner], axis=1)
            near = np.lexsort((where, found), axis=1)[:, :k]
            best[rows], place[rows] = np.take_along_axis(found, near, 1), np.take_along_axis(where, near, 1)
    return best, place, compared


def _searcher(k: int, same_row: bool, compared: Accumulator | None):
    """The search of one chunk for one block of queries."""
    columns = ["qk", "bk", "bv", "c", "d2"]

    def run(queries: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or base.empty:
            return pd.DataFrame(columns=columns)
        base = base.sort_values("bk", kind="stable").reset_index(drop=True)
        keys = base["bk"].to_numpy()
        asked, points = np.stack(queries["v"].to_numpy()), np.stack(base["bv"].to_numpy())
        qk = queries["qk"].to_numpy()
        best, place, n = search(asked, queries["r2"].to_numpy(float), qk if same_row else None, points, keys, k)
        if compared is not None:
            compared.add(n)
        rows, cols = np.nonzero(np.isfinite(best))
        hit = base.iloc[place[rows, cols]]
        return hit.assign(qk=qk[rows], d2=best[rows, cols])[columns]

    return run


def once(function):
    """The function, evaluated once per row; a second evaluation takes one more Python worker per task."""
    return function.asNondeterministic()


def nearest(
    queries: DataFrame,
    base: DataFrame,
    features: list[str],
    k: int,
    query_key: str,
    base_key: str,
    same_row: bool = False,
    carry: str | None = None,
    chunk_rows: int = CHUNK_ROWS,
    compared: Accumulator | None = None,
) -> DataFrame:
    """The k nearest base rows of every query row by Euclidean distance.

    Keys are whole numbers, features complete. Ties go to the smaller base key. With
    `same_row` a row is not its own neighbour. Result: (query_key, base_key, rank,
    distance, the neighbour as array `point`, and its column `carry` as `carried`).
    `compared` counts the distances computed.
    """
    asked = queries.select(q(query_key).cast("bigint").alias("qk"), _vector(features).alias("v"))
    extra = (q(carry) if carry else F.lit(None).cast("int")).alias("c")
    every = base.select(q(base_key).cast("bigint").alias("bk"), _vector(features).alias("v"), extra)
    schema = (
        "qk bigint, bk bigint, bv array<double>, "
        f"c {every.schema['c'].dataType.simpleString()}, d2 double"
    )
    # ties go to the smaller key, so of equal points only the first few can ever count
    copies = F.row_number().over(Window.partitionBy("v").orderBy("bk"))
    points = every.withColumn("copy", copies).filter(F.col("copy") <= k + int(same_row)).drop("copy")

    cells = min(CELLS, max(1, math.ceil(base.count() / chunk_rows)))
    sample = every.select("v").orderBy(F.xxhash64("bk")).limit(SAMPLE_PER_CELL * cells) if cells > 1 else every.limit(0)
    drawn = np.array([r["v"] for r in sample.select("v").collect()], float).reshape(-1, len(features))
    tree = cuts(drawn, cells)

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(cell_of(np.stack(v.to_numpy()), tree) if len(v) else [], dtype="int32")

    # Spark evaluates plain ones again in the filters that joins and explode imply
    points = points.withColumn("cell", once(cell)("v"))
    ends = [f(F.col("v")[i]) for f in (F.min, F.max) for i in range(len(features))]
    boxes = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.array(*ends).alias("ends")).orderBy("cell").collect()  # CELLS
    if not boxes:
        return _result(every.sparkSession.createDataFrame([], schema), k, query_key, base_key, carry)
    numbers = np.array([r["cell"] for r in boxes])
    low, high = np.split(np.array([r["ends"] for r in boxes], float), 2, axis=1)
    sizes = [(r["cell"], math.ceil(r["n"] / chunk_rows)) for r in boxes]
    slices = F.broadcast(every.sparkSession.createDataFrame(sizes, "cell int, slices int"))
    block = max(1, PAIR_BLOCK // len(boxes))

    def away(v: pd.Series):
        """Blocks of (their place, squared distances to all boxes)."""
        vectors = np.stack(v.to_numpy())
        for i in range(0, len(vectors), block):
            yield i, box_distance(vectors[i : i + block], low, high)

    @F.pandas_udf("int")
    def home_of(v: pd.Series) -> pd.Series:
        found = [numbers[d.argmin(axis=1)] for _, d in away(v)] if len(v) else [np.zeros(0)]
        return pd.Series(np.concatenate(found).astype("int32"))

    @F.pandas_udf("array<int>")
    def reached(v: pd.Series, r2: pd.Series) -> pd.Series:
        limit = r2.to_numpy(float) * SLACK
        return pd.Series([numbers[row <= limit[i + j]] for i, d in (away(v) if len(v) else []) for j, row in enumerate(d)], dtype=object)

    def part(key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col("slices")).cast("int")

    points = points.join(slices, "cell").select("cell", part("bk").alias("slice"), "bk", F.col("v").alias("bv"), "c")
    asked = asked.withColumn("cell", once(home_of)("v")).join(slices, "cell").withColumn("slice", part("qk"))
    run = _searcher(k, same_row, compared)
    home = _searched(asked.withColumn("r2", F.lit(math.inf)), points, run, schema)
    if len(sizes) == 1 and sizes[0][1] == 1:
        return _result(home, k, query_key, base_key, carry)
    bound = home.groupBy("qk").agg(F.when(F.count("bk") >= k, F.max("d2")).alias("r2"))
    bounded = skew.join_on(asked.withColumnsRenamed({"cell": "home", "slice": "own"}).drop("slices"), bound, ["qk"], "left")
    sent = bounded.withColumn("r2", F.coalesce("r2", F.lit(math.inf)))
    sent = sent.withColumn("cells", once(reached)("v", "r2")).withColumn("cell", F.explode("cells")).drop("cells").join(slices, "cell")
    sent = sent.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    found = home.unionByName(_searched(sent.filter("NOT (cell = home AND slice = own)"), points, run, schema))
    return _result(found, k, query_key, base_key, carry)


def _result(found: DataFrame, k: int, query_key: str, base_key: str, carry: str | None) -> DataFrame:
    order = Window.partitionBy("qk").orderBy("d2", "bk")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(
        F.col("qk").alias(query_key if query_key != base_key else "query"),
        F.col("bk").alias(base_key if query_key != base_key else "neighbor"),
        "rank",
        F.sqrt("d2").alias("distance"),
        F.col("bv").alias("point"),
        *([F.col("c").alias("carried")] if carry else []),
    )


def _searched(asked: DataFrame, points: DataFrame, run, schema: str) -> DataFrame:
    """Run the search per chunk, the queries of a busy cell cut into blocks."""
    counts = asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    # at most CELLS rows
    busy = F.broadcast(counts.select("cell", F.ceil(F.col("n") / QUERY_ROWS).cast("int").alias("blocks")))
    spread = asked.join(busy, "cell").withColumn("block", F.pmod(F.xxhash64("qk"), F.col("blocks")).cast("int"))
    repeated = points.join(busy, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["cell", "slice", "block"]
    # a given number, since the work is not in the bytes by which adaptive execution would merge tasks
    tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    queries = spread.select(*keys, "qk", "v", "r2").repartition(tasks, *keys).groupBy(*keys)
    rows = repeated.select(*keys, "bk", "bv", "c").repartition(tasks, *keys).groupBy(*keys)
    return queries.cogroup(rows).applyInPandas(run, schema)
