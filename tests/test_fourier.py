import numpy as np
import pandas as pd
import pytest

from plumbline.plans import fourier
from plumbline.plans.families import Plan
from plumbline.plans.fitting import fit
from plumbline.plans.tuning import tune


def waves(n=160):
    rng = np.random.default_rng(12)
    x = rng.uniform(-2, 2, (n, 2))
    y = 3 * np.sin(2 * x[:, 0]) + x[:, 1] ** 2 + 0.1 * rng.normal(size=n)
    return pd.DataFrame(x, columns=list("ab")).assign(id=np.arange(n), y=y, w=1.0 + np.arange(n) % 2)


def exact_svr(x, y, reg, epsilon, gamma):
    """The kernel's own solution, by Newton's steps on all pairs of rows."""
    n = len(x)
    kernel = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    alpha, b = np.zeros(n), 0.0
    for _ in range(200):
        rest = y - kernel @ alpha - b
        out = np.abs(rest) > epsilon
        k = out.sum()
        system = np.zeros((k + 1, k + 1))
        system[:k, :k] = kernel[np.ix_(out, out)] + reg * n * np.eye(k)
        system[:k, k] = system[k, :k] = 1
        found = np.linalg.solve(system, np.append(y[out] - np.sign(rest[out]) * epsilon, 0))
        goal = np.zeros(n)
        goal[out] = found[:k]
        alpha, b = alpha + 0.5 * (goal - alpha), b + 0.5 * (found[k] - b)
    return kernel @ alpha + b


def plan_of(**params):
    return Plan("svr", "regression", "y", ("a", "b"), "id", params=params)


def test_near_the_exact_solution_of_the_kernel(spark):
    frame = waves()
    x, y = frame[["a", "b"]].to_numpy(), frame["y"].to_numpy()
    scaled, aim = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1), (y - y.mean()) / y.std()
    expected = exact_svr(scaled, aim, 0.001, 0.1, 0.5) * y.std() + y.mean()
    rows = spark.createDataFrame(frame).repartition(6)
    got = {r["id"]: r["prediction"] for r in fit(plan_of(numFeatures=2000), rows).predict(rows).collect()}
    error = np.array([got[i] for i in frame["id"]]) - expected
    assert np.sqrt((error**2).mean()) < 0.05 * y.std()
    assert np.sqrt((expected - y) ** 2).mean() < 0.2 * y.std()  # and the exact one is a good fit


def test_the_solver_ends_at_the_minimum(spark):
    frame = waves(90)
    model = fit(plan_of(numFeatures=40, epsilon=0.2, regParam=0.01), spark.createDataFrame(frame).repartition(4), "w").model
    y, w = (frame["y"].to_numpy() - model.centre) / model.spread, frame["w"].to_numpy()
    z = model.cosines(frame[["a", "b"]].to_numpy())
    rest = y - z @ model.weights
    pull = np.sign(rest) * np.maximum(np.abs(rest) - 0.2, 0) * w
    gradient = 0.01 * np.append(model.weights[:-1], 0) - z.T @ pull / w.sum()
    assert np.abs(gradient).max() < 1e-8


def test_sums_of_many_tasks_are_added_up_in_a_tree(spark):
    parts = spark.range(0, 70, 1, 70).mapInPandas(
        lambda frames: (pd.DataFrame({"part": [np.array([i, 1.0]).tobytes() for i in f["id"]]}) for f in frames), "part binary"
    )
    assert fourier.tree_sum(parts, 4).tolist() == [sum(range(70)), 70]
    assert fourier.tree_sum(parts.limit(0)) is None


def test_single_rows_constant_columns_and_none(spark):
    schema = "id int, a double, b double, y double"
    one = spark.createDataFrame([(1, 2.0, 1.0, 5.0), (2, 3.0, 1.0, None)], schema)
    assert [round(r["prediction"], 6) for r in fit(plan_of(), one).predict(one).collect()] == [5.0, 5.0]
    assert fit(plan_of(), one).predict(one.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no rows"):
        fit(plan_of(), spark.createDataFrame([], schema))


def test_settings_are_searched(spark):
    best, table = tune(plan_of(), spark.createDataFrame(waves()), draws=2, folds=2)
    assert set(best.params) == {"regParam", "epsilon", "gamma"} and table.count() == 2
