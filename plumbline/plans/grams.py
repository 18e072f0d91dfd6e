"""Scores of linear models for many settings and folds from one pass over the data.

A least-squares model depends on its rows only through sums of products. Each task adds them up per
fold, Spark adds up the tasks, and the driver holds one small matrix per fold, whatever the number of
rows. The sums of all folds but one fit the model, those of the one left out measure it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAMILIES = ("linear_regression", "ridge", "lasso", "elasticnet")
CENTRE_ROWS = 1000
DEFAULTS = {
    "linear_regression": {"regParam": 0.0, "elasticNetParam": 0.0}, "ridge": {"regParam": 1.0, "elasticNetParam": 0.0},
    "lasso": {"regParam": 1.0, "elasticNetParam": 1.0}, "elasticnet": {"regParam": 1.0, "elasticNetParam": 0.5},
}


def fold_sums(rows: DataFrame) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Sums of products of (1, features, label) for each `fold`, and the centre they are taken from.

    Values are taken from the mean of a few rows, which changes no result but keeps the digits.
    """
    flat = rows.select(F.concat(vector_to_array("features"), F.array(F.col("label").cast("double"))).alias("v"), "fold")
    first = flat.limit(CENTRE_ROWS).collect()
    if not first:
        return {}, np.zeros(0)
    centre = np.array([r["v"] for r in first]).mean(axis=0)
    width = len(centre) + 1

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for fold, part in frame.groupby("fold"):
                z = np.ones((len(part), width))
                z[:, 1:] = np.stack(part["v"].to_numpy()) - centre
                sums[fold] = sums.get(fold, 0) + z.T @ z
        for fold, total in sums.items():
            yield pd.DataFrame({"fold": fold, "i": range(width), "sums": list(total)})

    parts = flat.mapInPandas(add, "fold int, i int, sums array<double>").select("fold", "i", F.posexplode("sums").alias("j", "s"))
    totals = parts.groupBy("fold", "i", "j").agg(F.sum("s").alias("s")).collect()  # width squared per fold
    found: dict[int, np.ndarray] = {}
    for r in totals:
        found.setdefault(r["fold"], np.zeros((width, width)))[r["i"], r["j"]] = r["s"]
    return found, centre


def solve(sums: np.ndarray, centre: np.ndarray, reg: float, net: float, intercept: bool) -> np.ndarray:
    """(intercept, coefficients) on values as they are, as Spark's least squares has them.

    Features and label are scaled to a standard deviation of one; `net` is the share of the absolute in
    the squared penalty.
    """
    n, mean = sums[0, 0], sums[0, 1:] / sums[0, 0]
    moments = sums[1:, 1:] / n
    spread = np.sqrt(np.maximum(np.diag(moments) - mean**2, 0))
    spread[spread <= 1e-12 * (1 + np.abs(mean + centre))] = 0
    if intercept:
        second = moments - np.outer(mean, mean)
    else:
        second = moments + np.outer(mean, centre) + np.outer(centre, mean) + np.outer(centre, centre)
    out = np.zeros(len(mean))
    y = spread[-1]
    used = np.flatnonzero(spread[:-1] > 0)
    whole = mean + centre
    if y == 0 or not len(used):
        out[0] = whole[-1] if intercept else 0.0
        return out
    scale = spread[used]
    a = second[np.ix_(used, used)] / np.outer(scale, scale)
    b = second[used, -1] / (scale * y)
    l1, l2 = net * reg / y, (1 - net) * reg / y
    if l1 == 0:
        weights = np.linalg.lstsq(a + l2 * np.eye(len(used)), b, rcond=None)[0]
    else:
        weights = np.zeros(len(used))
        for _ in range(10_000):
            before = weights.copy()
            for j in range(len(used)):
                rest = b[j] - a[j] @ weights + a[j, j] * weights[j]
                weights[j] = np.sign(rest) * max(abs(rest) - l1, 0) / (a[j, j] + l2)
            if np.abs(weights - before).max() < 1e-10:
                break
    out[1 + used] = weights * y / scale
    out[0] = whole[-1] - out[1:] @ whole[:-1] if intercept else 0.0
    return out


def r2(sums: np.ndarray, centre: np.ndarray, model: np.ndarray) -> float:
    """Share of the label's spread that the model explains on the rows of the sums."""
    at = np.concatenate([[model[0] + model[1:] @ centre[:-1] - centre[-1]], model[1:], [-1.0]])
    total = sums[-1, -1] - sums[0, -1] ** 2 / sums[0, 0]
    return float(1 - at @ sums @ at / total) if total > 0 else float("nan")


def scores(rows: DataFrame, family: str, settings: list[dict], pairs: list[tuple[list[int], int]]) -> list[float]:
    """The mean R² of each setting over (folds to fit, fold to measure)."""
    sums, centre = fold_sums(rows)
    out = []
    for s in settings:
        given = DEFAULTS[family] | s
        found = []
        for past, test in pairs:
            fit = sum((sums[f] for f in past if f in sums), np.zeros((len(centre) + 1,) * 2))
            if test in sums and fit[0, 0] > 0:
                model = solve(fit, centre, given["regParam"], given["elasticNetParam"], given.get("fitIntercept", True))
                found.append(r2(sums[test], centre, model))
        out.append(float(np.mean(found)) if found else float("nan"))
    return out
