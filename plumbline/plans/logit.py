"""Accuracies of two-class logistic models for many settings and folds, all fitted side by side.

One pass over the rows gives Newton's step of every model (setting and fold), so a search takes as many
passes as its slowest model has steps, about ten, and not the steps of all models one after another.
A task adds up gradients and second derivatives, one small matrix per model; `tree_sum` adds up the
tasks. The driver solves each step with its penalties and halves one that goes too far. What is minimised
is Spark's: the mean weighted loss plus penalties on the coefficients of features scaled to a standard
deviation of one, without one on the intercept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.durable import discard, materialize, stage_path
from plumbline.plans.blocks import taken
from plumbline.plans.fourier import tree_sum

FAMILY = "logistic_regression"
MOST_FEATURES = 64  # a task holds a matrix of their products per model
PASSES = 100
SWEEPS = 10_000
VALUES = 1 << 21  # of a task's margins and products at a time
BLOCK = "x binary, y binary, fold binary"


def _packed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows: features, labels and folds."""
    for x, y, fold in taken(batches, width):
        part = {"x": x.astype(float), "y": y.astype(np.int8), "fold": fold.astype(np.int32)}
        yield pa.RecordBatch.from_pylist([{k: v.tobytes() for k, v in part.items()}], pa.schema([(k, pa.binary()) for k in part]))


def _pieces(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(fold, features, labels) of at most `most` rows of a fold at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            x, y, fold = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("x", "d"), ("y", "i1"), ("fold", "i4")))
            x = x.reshape(-1, width)
            for f in np.unique(fold):
                here = np.flatnonzero(fold == f)
                for start in range(0, len(here), most):
                    places = here[start : start + most]
                    yield int(f), x[places], y[places]


def derivatives(z: np.ndarray, y: np.ndarray, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Per model (row of `v`) the loss, its gradient and its second derivatives, summed over the rows.

    `z` begins with ones; `w` has the weights of the rows in each model.
    """
    margin = z @ v.T
    at = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
    loss = (w * (np.logaddexp(0, margin) - y[:, None] * margin)).sum(axis=0)
    gradient = (w * (at - y[:, None])).T @ z
    i, j = np.triu_indices(z.shape[1])
    second = (w * at * (1 - at)).T @ (z[:, i] * z[:, j])
    return np.concatenate([loss[:, None], gradient, second], axis=1)


def goals(second: np.ndarray, gradient: np.ndarray, v: np.ndarray, l1: np.ndarray, l2: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Where each model's quadratic approximation round `v` plus its penalties is smallest."""
    u, width = np.where(used, v, 0.0), v.shape[1]
    aim = np.einsum("mij,mj->mi", second, v) - gradient
    for _ in range(SWEEPS):
        before = u.copy()
        for j in range(width):
            own = second[:, j, j]
            rest = aim[:, j] - np.einsum("mj,mj->m", second[:, j], u) + own * u[:, j]
            moved = np.sign(rest) * np.maximum(np.abs(rest) - l1[:, j], 0) / np.maximum(own + l2[:, j], 1e-300)
            u[:, j] = np.where(used[:, j], moved, 0.0)
        if np.abs(u - before).max(initial=0) < 1e-11:
            break
    return u


def _spread(n: np.ndarray, mean: np.ndarray, variance: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted sample deviations from the sizes, means and sample variances of groups of one weight."""
    total = (w * n).sum()
    middle = (w * n) @ mean / total
    squares = w @ (variance * np.maximum(n - 1, 0)[:, None] + n[:, None] * (mean - middle) ** 2)
    freedom = total - (w**2 * n).sum() / total
    return np.sqrt(np.maximum(squares / freedom, 0)) if freedom > 0 else np.zeros(mean.shape[1])


def scores(
    rows: DataFrame, settings: list[dict], pairs: list[tuple[list[int], int]], weighted: bool = False,
    level: Callable[[int], float] | None = None,
) -> list[float] | None:
    """The mean accuracy of each setting over (folds to fit, fold to measure).

    `rows` have `features`, `label` (0 or 1) and `fold`. With `weighted` the classes of the fitted folds
    weigh the same; then a model whose coefficients are all zero has an intercept of zero but for
    rounding, and answers by its sign: `level` gives that of a pair as Spark fits it. None where a fold is empty, or features are too many or not finite: fit one by one then.
    """
    spark = rows.sparkSession
    flat = rows.select(vector_to_array("features").alias("x"), F.col("label").alias("y"), F.col("fold").cast("double").alias("w"))
    groups = rows.groupBy("fold", "label").agg(
        F.count(F.lit(1)).alias("n"), Summarizer.metrics("mean", "variance").summary(F.col("features")).alias("x")
    ).orderBy("fold", "label").collect()  # two per fold
    if not groups:
        return None
    place = {(r["fold"], int(r["label"])): i for i, r in enumerate(groups)}
    size = np.array([r["n"] for r in groups], float)
    mean, variance = (np.array([r["x"][k].toArray() for r in groups]) for k in ("mean", "variance"))
    width, there = mean.shape[1], {f for f, _ in place}
    if width > MOST_FEATURES or not np.isfinite(variance).all() or any(t not in there or not there & set(past) for past, t in pairs):
        return None

    weights = np.zeros((len(pairs), len(groups)))  # of a row in the models of a pair
    spreads = np.zeros((len(pairs), width))
    constant: dict[int, int] = {}  # pairs whose fitted rows are of one class
    for p, (past, _) in enumerate(pairs):
        members = [[i for (f, c), i in place.items() if f in past and c == label] for label in (0, 1)]
        counts = [size[m].sum() for m in members]
        if not all(counts):
            constant[p] = int(counts[1] > 0)
        for m, n in zip(members, counts):
            weights[p, m] = sum(counts) / (sum(c > 0 for c in counts) * n) if weighted and n else 1.0
        every = members[0] + members[1]
        spreads[p] = _spread(size[every], mean[every], variance[every], weights[p, every])
    centre, scale = (size / size.sum()) @ mean, _spread(size, mean, variance, np.ones(len(groups)))
    scale[scale == 0] = 1.0

    hits = np.zeros((len(settings), len(pairs)))
    for p, c in constant.items():
        hits[:, p] = size[place[pairs[p][1], c]] if (pairs[p][1], c) in place else 0
    models = [(s, p) for s in range(len(settings)) for p in range(len(pairs)) if p not in constant]
    if models:
        path = stage_path(spark)
        try:
            blocks = materialize(flat.mapInArrow(lambda batches: _packed(batches, width), BLOCK), path)
            tests = np.array([pairs[p][1] for _, p in models])
            pair = np.array([p for _, p in models])
            given = [(settings[s].get("regParam", 0.0), settings[s].get("elasticNetParam", 0.0)) for s, _ in models]
            reg, net = np.array(given).T
            ratio = np.column_stack([np.zeros(len(models)), spreads[pair] / scale])
            used = np.column_stack([np.ones(len(models), bool), spreads[pair] > 0])
            counted, bare = _fitted(
                blocks, centre, scale, weights[pair], place, tests, (weights @ size)[pair],
                (reg * net)[:, None] * ratio, (reg * (1 - net))[:, None] * ratio**2, used,
            )
        finally:
            discard(spark, path)
        for (s, p), n in zip(models, counted):
            hits[s, p] = n
        for p in sorted({p for (_, p), b in zip(models, bare) if b}):
            past, t = pairs[p]
            ones, zeros = (sum(size[i] for (f, c), i in place.items() if f in past and c == label) for label in (1, 0))
            answer = int(level(p) > 0 if level else ones > zeros)
            same = [s for (s, of), b in zip(models, bare) if b and of == p]
            hits[same, p] = size[place[t, answer]] if (t, answer) in place else 0
    totals = np.array([sum(size[i] for (f, _), i in place.items() if f == t) for _, t in pairs])
    return [float(np.mean(h / totals)) for h in hits]


def _fitted(
    blocks: DataFrame, centre: np.ndarray, scale: np.ndarray, weights: np.ndarray, place: dict, tests: np.ndarray,
    mass: np.ndarray, l1: np.ndarray, l2: np.ndarray, used: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Right answers of each model on its test fold, and which models have no coefficients."""
    width = len(centre) + 1
    i, j = np.triu_indices(width)

    def at(v: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Objective, gradient of the loss, second derivatives and right answers of some models."""
        of, test = weights[which], tests[which]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(v), 2 + width + len(i)))
            for fold, x, y in _pieces(batches, width - 1, max(1, VALUES // (len(v) + len(i)))):
                z = np.column_stack([np.ones(len(x)), (x - centre) / scale])
                w = np.stack([of[:, place[fold, c]] if (fold, c) in place else np.zeros(len(v)) for c in (0, 1)])
                fits, asked = np.flatnonzero(w.any(axis=0)), np.flatnonzero(test == fold)
                total[fits, 1:] += derivatives(z, y, w[:, fits][y], v[fits])
                total[asked, 0] += ((z @ v[asked].T > 0) == (y[:, None] == 1)).sum(axis=0)
            yield pa.record_batch({"part": pa.array([total.tobytes()], pa.binary())})

        found = tree_sum(blocks.mapInArrow(add, "part binary")).reshape(len(v), -1)
        found[:, 1:] /= mass[which][:, None]
        second = np.zeros((len(v), width, width))
        second[:, i, j] = second[:, j, i] = found[:, 2 + width :]
        objective = found[:, 1] + (l1[which] * np.abs(v)).sum(axis=1) + (l2[which] * v**2).sum(axis=1) / 2
        return objective, found[:, 2 : 2 + width], second, found[:, 0]

    n = len(tests)
    here, best, hits = np.zeros((n, width)), np.full(n, np.inf), np.zeros(n)
    asked, goal, share = here.copy(), here.copy(), np.ones(n)
    going = np.arange(n)
    for _ in range(PASSES):
        value, gradient, second, right = at(asked[going], going)
        good = value <= best[going] + 1e-14 * np.abs(value)
        kept = going[good]
        here[kept], best[kept], hits[kept], share[kept] = asked[kept], value[good], right[good], 1.0
        goal[kept] = goals(second[good], gradient[good], here[kept], l1[kept], l2[kept], used[kept])
        share[going[~good]] /= 2  # too far
        asked[going] = here[going] + share[going, None] * (goal[going] - here[going])
        going = going[np.abs(asked[going] - here[going]).max(axis=1) > 1e-9]
        if not len(going):
            break
    return hits, ~here[:, 1:].any(axis=1)
