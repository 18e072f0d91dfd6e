"""Support vector regression with a Gaussian kernel, by random Fourier features.

The kernel exp(-gamma |a - b|²) of scaled features is the mean of products of cosines with random
frequencies, so a linear model on `numFeatures` cosines stands for the kernel, and no task compares rows
with rows. The error falls with the root of their number. What is minimised, with `label` scaled to a
standard deviation of one, is regParam / 2 |v|² plus half the mean of squared distances beyond `epsilon`;
the intercept has no penalty. Newton's steps need the sums of products of the rows outside the tube: a
task adds up one matrix, `tree_sum` adds up the tasks, and the driver holds one matrix. The rows are
packed into blocks once, in which the cosines and products of rows with equal features are computed once.

Rows without a label take no part. Features that do not vary count as 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.durable import discard, materialize, stage_path
from plumbline.plans.blocks import distinct, taken

FAN_IN = 32
BLOCK = "x binary, kind binary, y binary, w binary"
COSINES = 1 << 23  # values that a task holds at a time


def _add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for frame in frames:
        for part in frame["part"]:
            values = np.frombuffer(part)
            total = values if total is None else total + values
    if total is not None:
        yield pd.DataFrame({"part": [total.tobytes()]})


def tree_sum(parts: DataFrame, fan_in: int = FAN_IN) -> np.ndarray | None:
    """The sum of equally long vectors of doubles in `part`, one per task, added up `fan_in` at a time.

    No task and not the driver reads more than about `fan_in` of them. None without rows.
    """
    n = parts.rdd.getNumPartitions()
    while n > fan_in:
        n = -(-n // fan_in)
        parts = parts.repartition(n).mapInPandas(_add_up, "part binary")
    found = [np.frombuffer(r["part"]) for r in parts.collect()]
    return np.sum(found, axis=0) if found else None


class Cosines:
    """Scaling of the features and their random cosines, the last of which is a constant one."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, gamma: float, n: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.frequencies = rng.normal(scale=np.sqrt(2 * gamma), size=(len(mean), n))
        self.phases = rng.uniform(0, 2 * np.pi, n)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        scaled = np.divide(x - self.mean, self.spread, out=np.zeros_like(x), where=self.spread > 0)
        out = np.ones((len(x), len(self.phases) + 1))
        out[:, :-1] = np.sqrt(2 / len(self.phases)) * np.cos(scaled @ self.frequencies + self.phases)
        return out


def outside(z: np.ndarray, kind: np.ndarray, y: np.ndarray, w: np.ndarray, v: np.ndarray, epsilon: float) -> np.ndarray:
    """Sums over rows outside the tube: products of (z, y moved to the tube's edge), and the loss.

    `kind` is the place of each row's cosines in `z`, so products are those of the places.
    """
    rest = y - (z @ v)[kind]
    out = np.abs(rest) > epsilon
    kind, w, rest = kind[out], w[out], rest[out]
    edge = y[out] - np.sign(rest) * epsilon
    mass, aim = (np.bincount(kind, values, len(z)) for values in (w, w * edge))
    used = np.flatnonzero(mass)
    z, mass, aim = z[used], mass[used], aim[used]
    products = np.empty((z.shape[1] + 1,) * 2)
    products[:-1, :-1] = z.T * mass @ z
    products[-1, :-1] = products[:-1, -1] = z.T @ aim
    products[-1, -1] = (w * edge**2).sum()
    return np.append(products.ravel(), (w * (np.abs(rest) - epsilon) ** 2).sum() / 2)


def _packed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows: the different features, and of each row its place there, label and weight."""
    for x, y, w in taken(batches, width):
        places, kind = distinct(x)
        part = {"x": x[places], "kind": kind.astype(np.int32), "y": y, "w": w}
        yield pa.RecordBatch.from_pylist([{k: v.tobytes() for k, v in part.items()}], pa.schema([(k, pa.binary()) for k in part]))


def _pieces(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Features, and their rows' places, labels and weights, at most `most` different features at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            x, kind, y, w = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in zip(("x", "kind", "y", "w"), "didd"))
            x = x.reshape(-1, width)
            for start in range(0, len(x), most):
                here = slice(None) if len(x) <= most else (kind >= start) & (kind < start + most)
                yield x[start : start + most], kind[here] - start, y[here], w[here]


class FourierSVRModel(Model):
    def __init__(self, cosines: Cosines, weights: np.ndarray, centre: float, spread: float):
        super().__init__()
        self.cosines, self.weights, self.centre, self.spread = cosines, weights, centre, spread

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cosines, weights, centre, spread = self.cosines, self.weights, self.centre, self.spread

        @F.pandas_udf("double")
        def predict(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype=float)
            return pd.Series(centre + spread * (cosines(np.stack(values.to_numpy()).astype(float)) @ weights))

        return dataset.withColumn("prediction", predict(vector_to_array("features")))


class FourierSVR(Estimator):
    """On columns `features` and `label`; `gamma` 0 stands for one over the number of features."""

    regParam = Param(Params._dummy(), "regParam", "penalty on squared weights", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "half the width of the tube, in standard deviations", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "of the kernel, on scaled features", TypeConverters.toFloat)
    numFeatures = Param(Params._dummy(), "numFeatures", "cosines", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "passes at most", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "of the frequencies", TypeConverters.toInt)

    def __init__(self, weightCol: str | None = None, **params):
        super().__init__()
        self.weight = weightCol
        self._setDefault(regParam=0.001, epsilon=0.1, gamma=0.0, numFeatures=200, maxIter=30, seed=42)
        self._set(**params)

    def _fit(self, dataset: DataFrame) -> FourierSVRModel:
        weight = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        rows = dataset.select("features", F.col("label").cast("double").alias("y"), weight.alias("w")).filter("y IS NOT NULL")
        if rows.isEmpty():
            raise ValueError("no rows with a label to fit")
        first = rows.agg(
            F.sum("w").alias("n"), F.avg("y").alias("centre"), F.stddev_pop("y").alias("spread"),
            Summarizer.metrics("mean", "std").summary(F.col("features")).alias("x"),
        ).first()
        mean, spread = first["x"]["mean"].toArray(), first["x"]["std"].toArray()
        gamma = self.getOrDefault(self.gamma) or 1 / len(mean)
        cosines = Cosines(mean, spread, gamma, self.getOrDefault(self.numFeatures), self.getOrDefault(self.seed))
        centre, scale = first["centre"], first["spread"] or 1.0
        size, reg, epsilon = len(cosines.phases) + 1, self.getOrDefault(self.regParam), self.getOrDefault(self.epsilon)
        flat = rows.select(vector_to_array("features").alias("x"), ((F.col("y") - centre) / scale).alias("y"), "w")
        penalty = np.append(np.full(size - 1, reg), 0.0)

        width, path = len(mean), stage_path(dataset.sparkSession)
        blocks = materialize(flat.mapInArrow(lambda batches: _packed(batches, width), BLOCK), path)

        def at(v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            """The objective, its gradient, and where Newton's step leads."""

            def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros((size + 1) ** 2 + 1)
                for x, kind, y, w in _pieces(batches, width, max(1, COSINES // size)):
                    total += outside(cosines(x), kind, y, w, v, epsilon)
                yield pa.record_batch({"part": pa.array([total.tobytes()], pa.binary())})

            sums = tree_sum(blocks.mapInArrow(add, "part binary")) / first["n"]
            products = sums[:-1].reshape(size + 1, size + 1)
            second, aim = products[:-1, :-1] + np.diag(penalty), products[:-1, -1]
            goal = np.linalg.lstsq(second, aim, rcond=None)[0]
            return sums[-1] + penalty @ v**2 / 2, second @ v - aim, goal

        try:
            v = np.zeros(size)
            value, gradient, goal = at(v)
            passes, share = 1, 1.0
            while passes < self.getOrDefault(self.maxIter) and np.abs(gradient).max() > 1e-9 and share > 1e-4:
                moved = v + share * (goal - v)
                found = at(moved)
                passes += 1
                if found[0] <= value:
                    v, (value, gradient, goal), share = moved, found, 1.0
                else:  # too far: the rows outside the tube change on the way
                    share /= 2
        finally:
            discard(dataset.sparkSession, path)
        return FourierSVRModel(cosines, v, centre, scale)
