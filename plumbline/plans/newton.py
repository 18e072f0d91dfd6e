"""Gradient boosting of second order, from histograms of gradients and Hessians.

Every feature is cut at its quantiles once (mergeable sketches, one aggregation), and a row is kept as
one byte per feature, packed into blocks: tasks combine rows with equal bytes, which have equal margins
(and, but for squared loss, equal labels), into one of their summed weight. A level of a tree is one job: tasks add up gradients and Hessians per node, feature
and bin, Spark adds up the tasks, and windows over the bins find the best split of each node. The driver
receives one row per node and class, whatever the number of rows or features.

Margins are written every `KEEP` rounds, so a task walks at most that many trees and a lost executor costs
no more. Rows without a label take no part. Missing values (null or NaN) have a bin of their own and go
to the side that gains more, a choice made per split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.durable import discard, materialize, stage_path
from plumbline.plans.blocks import distinct, taken

KEEP = 8
MOST_BINS = 255
BLOCK_ROWS = 1 << 16
STATE = "codes binary, y binary, w binary, margin binary"
CELLS = "c int, node int, f int, bin int, g double, h double"


@dataclass
class Tree:
    """Nodes in heap order; `feature` is -1 in a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def leaf(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.zeros(n, bool), np.zeros(n))

    def walk(self, codes: np.ndarray, missing: int) -> np.ndarray:
        """The node in which each row ends."""
        at, rows = np.zeros(len(codes), int), np.arange(len(codes))
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return at
            code = codes[rows, np.maximum(self.feature[at], 0)]
            left = np.where(code == missing, self.missing_left[at], code <= self.cut[at])
            at = np.where(inner, 2 * at + 2 - left, at)


def bin_codes(values: np.ndarray, cuts: list[np.ndarray], missing: int) -> np.ndarray:
    """The number of cuts below each value; `missing` where it is NaN."""
    out = np.empty(values.shape, np.uint8)
    for f, at in enumerate(cuts):
        out[:, f] = np.searchsorted(at, values[:, f], side="left")
    out[np.isnan(values)] = missing
    return out


def gradients(margin: np.ndarray, y: np.ndarray, w: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by each margin, (rows, margins)."""
    if loss == "squared":
        g, h = margin - y[:, None], np.ones_like(margin)
    elif loss == "logistic":
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y[:, None], p * (1 - p)
    else:
        e = np.exp(margin - margin.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        g, h = p - (y[:, None] == np.arange(margin.shape[1])), p * (1 - p)
    return g * w[:, None], np.maximum(h, 1e-16) * w[:, None]


def add_trees(margin: np.ndarray, codes: np.ndarray, rounds: list[list[Tree]], missing: int) -> np.ndarray:
    for trees in rounds:
        for c, tree in enumerate(trees):
            margin[:, c] += tree.value[tree.walk(codes, missing)]
    return margin


def combined(codes: np.ndarray, y: np.ndarray, w: np.ndarray, squared: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of equal codes as one with their weight, if that halves them.

    Squared loss needs the mean label of such rows only, the others keep the labels apart.
    """
    keys = codes if squared else np.hstack([codes, y[:, None].copy().view(np.uint8)])
    places, which = distinct(keys)
    if 2 * len(places) > len(y):
        return codes, y, w
    weight = np.bincount(which, w, len(places))
    if not squared:
        return codes[places], y[places], weight
    total = np.bincount(which, w * y, len(places))
    return codes[places], np.divide(total, weight, out=np.zeros_like(total), where=weight != 0), weight


def _blocks(codes: np.ndarray, y: np.ndarray, w: np.ndarray, margin: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(y), BLOCK_ROWS):
        part = {k: v[i : i + BLOCK_ROWS].tobytes() for k, v in (("codes", codes), ("y", y), ("w", w), ("margin", margin))}
        yield pa.RecordBatch.from_pylist([part], pa.schema([(k, pa.binary()) for k in part]))


def _unpack(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Codes, labels, weights and margins of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            codes, y, w, margin = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in zip(("codes", "y", "w", "margin"), "Bddd"))
            yield codes.reshape(-1, width), y, w, margin.reshape(len(y), -1).copy()


def _cells(state: DataFrame, done: list[list[Tree]], trees: list[Tree], level: int, width: int, bins: int, loss: str) -> DataFrame:
    """Each task's sums of gradients and Hessians per margin, node of the level, feature and bin."""
    first, nodes = 2**level - 1, 2**level

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (len(trees), nodes, width, bins + 1)
        g_sum, h_sum = np.zeros(shape), np.zeros(shape)
        places = np.arange(width) * (bins + 1)
        for codes, y, w, margin in _unpack(batches, width):
            g, h = gradients(add_trees(margin, codes, done, bins), y, w, loss)
            for c, tree in enumerate(trees):
                node = tree.walk(codes, bins) - first
                open_ = node >= 0  # the others ended in a leaf above
                cell = (node[open_, None] * width * (bins + 1) + places + codes[open_]).ravel()
                for sums, values in ((g_sum, g), (h_sum, h)):
                    sums[c] += np.bincount(cell, np.repeat(values[open_, c], width), sums[c].size).reshape(sums[c].shape)
        c, node, f, b = np.nonzero(h_sum)
        places = {k: pa.array(v, pa.int32()) for k, v in (("c", c), ("node", node + first), ("f", f), ("bin", b))}
        yield pa.record_batch({**places, "g": pa.array(g_sum[c, node, f, b]), "h": pa.array(h_sum[c, node, f, b])})

    return state.mapInArrow(add, CELLS)


BEST_SPLITS = """
    WITH sums AS (SELECT c, node, f, bin, sum(g) AS g, sum(h) AS h FROM {cells} GROUP BY c, node, f, bin),
         dealt AS (SELECT /*+ REPARTITION(c, node) */ * FROM sums),
         sides AS (SELECT *, sum(g) OVER each AS g_all, sum(h) OVER each AS h_all, sum(g) OVER so_far AS g_low, sum(h) OVER so_far AS h_low,
                          coalesce(sum(IF(bin = :bins, g, NULL)) OVER each, 0D) AS g_gone,
                          coalesce(sum(IF(bin = :bins, h, NULL)) OVER each, 0D) AS h_gone
                   FROM dealt WINDOW each AS (PARTITION BY c, node, f), so_far AS (PARTITION BY c, node, f ORDER BY bin ROWS UNBOUNDED PRECEDING)),
         options AS (SELECT c, node, f, bin, g_all, h_all, missing_right, o.g, o.h
                     FROM sides LATERAL VIEW inline(array(struct(TRUE AS r, g_low AS g, h_low AS h), struct(FALSE AS r, g_low + g_gone AS g, h_low + h_gone AS h))) o AS missing_right, g, h
                     WHERE missing_right OR h_gone > 0)
    SELECT c, node, inline(array(max(struct(
               IF(bin < :bins AND h >= :least AND h_all - h >= :least AND h_all - h > 0,
                  g * g / (h + :penalty) + (g_all - g) * (g_all - g) / (h_all - h + :penalty) - g_all * g_all / (h_all + :penalty), -1D) AS gain,
               -f AS f, -bin AS bin, missing_right, g, h, g_all, h_all))))
    FROM options GROUP BY c, node
    """


def best_splits(cells: DataFrame, bins: int, penalty: float, least: float) -> DataFrame:
    """One row per (c, node): the split with the highest gain, the sums of its left side and of both.

    The bin numbered `bins` holds missing values. Ties go to the smaller feature, then the smaller bin,
    then missing values to the right. Without a split that leaves `least` Hessian on both sides the gain
    is -1. A node's sums, features times bins of them, meet in one task for both windows and the maximum.
    """
    given = {"bins": bins, "penalty": float(penalty), "least": float(least)}
    return cells.sparkSession.sql(BEST_SPLITS, given, cells=cells)


class NewtonModel(Model):
    """Adds `prediction`: the value, or the number of the class."""

    def __init__(self, cuts: list[np.ndarray], bins: int, base: np.ndarray, rounds: list[list[Tree]], loss: str, gains: np.ndarray):
        super().__init__()
        self.cuts, self.bins, self.base, self.rounds, self.loss = cuts, bins, base, rounds, loss
        total = gains.sum()
        self.featureImportances = DenseVector(gains / total if total > 0 else gains)

    def margins(self, values: np.ndarray) -> np.ndarray:
        codes = bin_codes(values, self.cuts, self.bins)
        return add_trees(np.tile(self.base, (len(values), 1)), codes, self.rounds, self.bins)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cuts, bins, base, rounds, loss = self.cuts, self.bins, self.base, self.rounds, self.loss

        @F.pandas_udf("double")
        def predict(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype=float)
            codes = bin_codes(np.stack(values.to_numpy()).astype(float), cuts, bins)
            margin = add_trees(np.tile(base, (len(codes), 1)), codes, rounds, bins)
            if loss == "squared":
                return pd.Series(margin[:, 0])
            return pd.Series((margin[:, 0] > 0).astype(float) if loss == "logistic" else margin.argmax(axis=1).astype(float))

        return dataset.withColumn("prediction", predict(vector_to_array("features")))


class BoostedNewton(Estimator):
    """Squared loss, logistic loss for two classes, softmax for more, on columns `features` and `label`.

    A leaf is -G / (H + regLambda) times `stepSize`. A split needs `minChildWeight` Hessian on both sides.
    """

    maxIter = Param(Params._dummy(), "maxIter", "rounds", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of a tree", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "share of a leaf that is added", TypeConverters.toFloat)
    regLambda = Param(Params._dummy(), "regLambda", "penalty on squared leaves", TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "least Hessian of a child", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature, 255 at most", TypeConverters.toInt)

    def __init__(self, classes: int | None = None, weightCol: str | None = None, **params):
        super().__init__()
        self.loss = "squared" if classes is None else "logistic" if classes <= 2 else "softmax"
        self.classes, self.weight = classes or 0, weightCol
        self._setDefault(maxIter=10, maxDepth=4, stepSize=0.3, regLambda=1.0, minChildWeight=1.0, maxBins=64)
        self._set(**params)

    def _fit(self, dataset: DataFrame) -> NewtonModel:
        spark = dataset.sparkSession
        weight = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        rows = dataset.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"), weight.alias("w"))
        rows = rows.filter("y IS NOT NULL")
        first = rows.select(F.size("x").alias("n")).first()
        if first is None:
            raise ValueError("no rows with a label to fit")
        width, bins = first["n"], self.getOrDefault(self.maxBins)
        if not 2 <= bins <= MOST_BINS:
            raise ValueError(f"maxBins must be from 2 to {MOST_BINS}")
        cuts, base = self._prepare(rows, width, bins)

        squared = self.loss == "squared"

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x, y, w in taken(batches, width):
                codes, y, w = combined(bin_codes(x, cuts, bins), y, w, squared)
                yield from _blocks(codes, y, w, np.tile(base, (len(y), 1)))

        path = stage_path(spark)
        state, rounds, kept = materialize(rows.mapInArrow(encode, STATE), path), [], 0
        gains = np.zeros(width)
        try:
            for i in range(self.getOrDefault(self.maxIter)):
                if i and i % KEEP == 0:
                    state, path, old = *self._advance(state, rounds[kept:], width, bins), path
                    discard(spark, old)
                    kept = len(rounds)
                rounds.append(self._grow(state, rounds[kept:], width, bins, gains))
        finally:
            discard(spark, path)
        return NewtonModel(cuts, bins, base, rounds, self.loss, gains)

    def _prepare(self, rows: DataFrame, width: int, bins: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Cuts at the quantiles of every feature and the margins to begin with, in one aggregation."""
        shares = [i / bins for i in range(1, bins)]
        known = [F.when(~F.isnan(F.col("x")[f]), F.col("x")[f]) for f in range(width)]
        quantiles = [F.percentile_approx(x, shares, 50 * bins).alias(f"q{f}") for f, x in enumerate(known)]
        total, mass = F.sum("w"), [F.sum(F.when(F.col("y") == c, F.col("w")).otherwise(0.0)) for c in range(self.classes)]
        found = rows.agg(*quantiles, total.alias("total"), F.sum(F.col("w") * F.col("y")).alias("mean"), F.array(*mass).alias("mass")).first()
        cuts = [np.unique(np.array(found[f"q{f}"] or [], float)) for f in range(width)]
        if self.loss == "squared":
            return cuts, np.array([found["mean"] / found["total"]])
        share = np.clip(np.array(found["mass"]) / found["total"], 1e-6, 1 - 1e-6)
        if self.loss == "logistic":
            positive = share[1] if self.classes > 1 else 1e-6
            return cuts, np.array([np.log(positive / (1 - positive))])
        return cuts, np.log(share)

    def _advance(self, state: DataFrame, done: list[list[Tree]], width: int, bins: int) -> tuple[DataFrame, str]:
        """The state with the margins after `done`, written."""

        def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for codes, y, w, margin in _unpack(batches, width):
                yield from _blocks(codes, y, w, add_trees(margin, codes, done, bins))

        path = stage_path(state.sparkSession)
        return materialize(state.mapInArrow(advance, STATE), path), path

    def _grow(self, state: DataFrame, done: list[list[Tree]], width: int, bins: int, gains: np.ndarray) -> list[Tree]:
        """One tree per margin, a job per level; gains are added to those of their features."""
        depth, step, penalty = (self.getOrDefault(p) for p in (self.maxDepth, self.stepSize, self.regLambda))
        trees = [Tree.leaf(depth) for _ in range(self.classes if self.loss == "softmax" else 1)]
        for level in range(depth):
            cells = _cells(state, done, trees, level, width, bins, self.loss)
            found = best_splits(cells, bins, penalty, self.getOrDefault(self.minChildWeight)).collect()  # one per node
            grown = False
            for r in found:
                tree, node = trees[r["c"]], r["node"]
                if level == 0:
                    tree.value[0] = -step * r["g_all"] / (r["h_all"] + penalty)
                if r["gain"] <= 1e-12 * (1 + abs(r["g_all"])):
                    continue
                grown = True
                tree.feature[node], tree.cut[node], tree.missing_left[node] = -r["f"], -r["bin"], not r["missing_right"]
                tree.value[2 * node + 1] = -step * r["g"] / (r["h"] + penalty)
                tree.value[2 * node + 2] = -step * (r["g_all"] - r["g"]) / (r["h_all"] - r["h"] + penalty)
                gains[-r["f"]] += r["gain"]
            if not grown:
                break
        return trees
