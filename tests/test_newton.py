import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.plans import newton
from plumbline.plans.families import SEARCH, Plan
from plumbline.plans.fitting import fit, importance
from plumbline.plans.tuning import tune


def frame_of(loss, n=240, missing=True):
    rng = np.random.default_rng(31)
    x = rng.integers(0, 12, (n, 3)).astype(float)
    score = x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=n)
    if missing:
        x[rng.random(n) < 0.2, 1] = np.nan
        score = score + 4 * np.isnan(x[:, 1])
    y = score if loss == "squared" else np.digitize(score, [4.0] if loss == "logistic" else [2.0, 6.0])
    frame = pd.DataFrame(x, columns=list("abc")).assign(id=np.arange(n), y=y, w=1.0 + np.arange(n) % 3)
    return frame


def plain_boosting(x, y, w, loss, classes, rounds, depth, step, penalty, least):
    """Every cut between values of every feature, both sides for missing ones."""
    if loss == "squared":
        margin = np.full((len(x), 1), np.average(y, weights=w))
    else:
        share = np.array([w[y == c].sum() for c in range(classes)]) / w.sum()
        margin = np.tile(np.log(share) if loss == "softmax" else [np.log(share[1] / share[0])], (len(x), 1))
    for _ in range(rounds):
        if loss == "squared":
            g, h = (margin - y[:, None]) * w[:, None], np.tile(w[:, None], (1, 1))
        elif loss == "logistic":
            p = 1 / (1 + np.exp(-margin))
            g, h = (p - y[:, None]) * w[:, None], p * (1 - p) * w[:, None]
        else:
            p = np.exp(margin) / np.exp(margin).sum(axis=1, keepdims=True)
            g, h = (p - np.eye(classes)[y.astype(int)]) * w[:, None], p * (1 - p) * w[:, None]

        def grow(rows, c, level):
            total_g, total_h = g[rows, c].sum(), h[rows, c].sum()
            best = None
            if level < depth:
                for f in range(x.shape[1]):
                    v = x[rows, f]
                    gone = np.isnan(v)
                    for cut in np.unique(v[~gone]):
                        for missing_left in (False, True) if gone.any() else (False,):
                            left = (v <= cut) | (gone & missing_left)
                            gl, hl = g[rows[left], c].sum(), h[rows[left], c].sum()
                            gr, hr = total_g - gl, total_h - hl
                            if hl < least or hr < least or not (~left).any():
                                continue
                            gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - total_g**2 / (total_h + penalty)
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                                best = gain, left
            if best is None:
                return [(rows, -step * total_g / (total_h + penalty))]
            return grow(rows[best[1]], c, level + 1) + grow(rows[~best[1]], c, level + 1)

        added = np.zeros_like(margin)
        for c in range(margin.shape[1]):
            for rows, value in grow(np.arange(len(x)), c, 0):
                added[rows, c] += value
        margin = margin + added
    return margin


@pytest.mark.parametrize("loss, classes", [("squared", None), ("logistic", 2), ("softmax", 3)])
def test_margins_equal_a_plain_version(spark, loss, classes, monkeypatch):
    monkeypatch.setattr(newton, "KEEP", 2)  # margins are written once on the way
    frame = frame_of(loss)
    x, y, w = frame[list("abc")].to_numpy(), frame["y"].to_numpy(float), frame["w"].to_numpy()
    settings = {"maxIter": 3, "maxDepth": 2, "stepSize": 0.4, "regLambda": 0.7, "minChildWeight": 2.0}
    plan = Plan("boosted_newton", "regression" if loss == "squared" else "classification", "y", tuple("abc"), "id", params=settings)
    rows = spark.createDataFrame(frame).repartition(5)
    fitted = fit(plan, rows, "w")
    expected = plain_boosting(x, y, w, loss, classes, 3, 2, 0.4, 0.7, 2.0)
    assert np.allclose(fitted.model.margins(x), expected, atol=1e-9)
    got = {r["id"]: r["prediction"] for r in fitted.predict(rows).collect()}
    told = expected[:, 0] if loss == "squared" else (expected[:, 0] > 0) if loss == "logistic" else expected.argmax(axis=1)
    assert np.allclose([got[i] for i in frame["id"]], told, atol=1e-9)


def test_missing_values_of_either_kind_choose_a_side(spark):
    rows = spark.range(400).select(
        "id", F.expr("CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN double('NaN') ELSE double(id % 7) END").alias("a"), F.lit(1.0).alias("same"),
        F.expr("IF(id % 4 < 2, 10.0, 0.0)").alias("y"),
    )
    plan = Plan("boosted_newton", "regression", "y", ("a", "same"), "id", params={"maxIter": 9, "maxDepth": 1, "stepSize": 0.8})
    fitted = fit(plan, rows)
    wrong = fitted.predict(rows).filter("abs(label - prediction) > 0.1")
    assert wrong.count() == 0
    assert {r["feature"]: r["importance"] for r in importance(fitted).collect()} == {"a": 1.0, "same": 0.0}


def test_rows_without_split_label_or_any(spark):
    schema = "id int, a double, y double"
    plan = Plan("boosted_newton", "regression", "y", ("a",), "id", params={"maxIter": 3})
    one = spark.createDataFrame([(1, 2.0, 5.0), (2, None, None)], schema)
    assert [r["prediction"] for r in fit(plan, one).predict(one).collect()] == [5.0, 5.0]
    with pytest.raises(ValueError, match="no rows"):
        fit(plan, spark.createDataFrame([], schema))
    with pytest.raises(ValueError, match="maxBins"):
        fit(Plan("boosted_newton", "regression", "y", ("a",), "id", params={"maxBins": 300}), one)
    assert fit(plan, one).predict(one.limit(0)).count() == 0


def test_settings_are_searched(spark, monkeypatch):
    monkeypatch.setitem(SEARCH, "boosted_newton", SEARCH["boosted_newton"] | {"maxIter": [2, 3], "maxDepth": [2]})
    plan = Plan("boosted_newton", "classification", "y", ("a", "b", "c"), "id")
    best, table = tune(plan, spark.createDataFrame(frame_of("logistic")), draws=2, folds=2)
    assert set(best.params) == {"maxIter", "maxDepth", "stepSize", "regLambda", "minChildWeight"}
    assert table.filter("score > 0.7").count() >= 1
