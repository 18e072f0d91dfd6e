"""Model families per task and three differing candidate plans."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from random import Random

from pyspark.ml import Estimator
from pyspark.ml import classification as cls
from pyspark.ml import regression as reg

from plumbline.plans.bayes import SmoothedBayes
from plumbline.plans.fourier import FourierSVR
from plumbline.plans.newton import BoostedNewton

SEED = 42
TASKS = ("classification", "regression", "timeseries")

# Families offered per task; `boosted_newton` is the second-order form of boosting.
FAMILIES = {
    "classification": (
        "logistic_regression", "random_forest", "gradient_boosting", "svm", "knn",
        "decision_tree", "naive_bayes", "boosted_newton",
    ),
    "regression": (
        "linear_regression", "ridge", "lasso", "random_forest", "gradient_boosting",
        "svr", "elasticnet", "decision_tree", "boosted_newton",
    ),
    "timeseries": ("random_forest", "gradient_boosting", "decision_tree", "ridge", "lasso", "boosted_newton"),
}

# Families that place missing values themselves; the others need complete rows.
TAKES_MISSING = ("boosted_newton",)

# Simple, balanced, strong: three different families per task.
CANDIDATES = {
    "classification": ("logistic_regression", "decision_tree", "gradient_boosting"),
    "regression": ("linear_regression", "decision_tree", "gradient_boosting"),
    "timeseries": ("ridge", "decision_tree", "gradient_boosting"),
}

@dataclass(frozen=True)
class Range:
    """Any value from `low` to `high`, drawn evenly or, with `log`, evenly in its logarithm."""

    low: float
    high: float
    log: bool = False

    def draw(self, rng: Random) -> float:
        if self.log:
            return math.exp(rng.uniform(math.log(self.low), math.log(self.high)))
        return rng.uniform(self.low, self.high)


# What the random search draws from: ranges, or values to choose from. The penalty of plain least
# squares is too small to matter but for columns that almost determine each other.
SEARCH = {
    "logistic_regression": {"regParam": Range(1e-4, 1.0, log=True), "elasticNetParam": Range(0.0, 1.0)},
    "random_forest": {"numTrees": [10, 20, 40, 80], "maxDepth": [3, 5, 8], "minInstancesPerNode": [1, 5, 20]},
    "gradient_boosting": {"maxIter": [5, 10, 20], "maxDepth": [2, 3, 5], "stepSize": Range(0.02, 0.3, log=True)},
    "boosted_newton": {
        "maxIter": [10, 20, 40], "maxDepth": [2, 3, 4, 6], "stepSize": Range(0.05, 0.5, log=True),
        "regLambda": Range(0.1, 10.0, log=True), "minChildWeight": [1.0, 5.0, 20.0],
    },
    "svm": {"regParam": Range(1e-4, 1.0, log=True), "maxIter": [20, 50, 100, 200]},
    "svr": {"regParam": Range(1e-5, 0.1, log=True), "epsilon": Range(0.01, 0.5, log=True), "gamma": Range(0.01, 2.0, log=True)},
    "decision_tree": {"maxDepth": [2, 3, 5, 8, 10], "minInstancesPerNode": [1, 5, 20, 50]},
    "naive_bayes": {"varSmoothing": Range(1e-9, 0.1, log=True)},
    "linear_regression": {"regParam": Range(1e-9, 1e-4, log=True), "fitIntercept": [True, True, False]},
    "ridge": {"regParam": Range(1e-3, 10.0, log=True)},
    "lasso": {"regParam": Range(1e-3, 10.0, log=True)},
    "elasticnet": {"regParam": Range(1e-3, 10.0, log=True), "elasticNetParam": Range(0.05, 0.95)},
}


@dataclass(frozen=True)
class Plan:
    """What to predict from which columns, with which kind of model."""

    family: str
    task: str
    target: str
    features: tuple[str, ...]
    key: str
    time: str | None = None
    params: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.task not in TASKS:
            raise ValueError(f"task must be one of {TASKS}")
        if self.family not in FAMILIES[self.task]:
            raise ValueError(f"{self.task} offers {FAMILIES[self.task]}")


def candidates(
    task: str, target: str, features: list[str], key: str, time: str | None = None
) -> list[Plan]:
    """A simple, a balanced and a strong plan, each of another family."""
    return [Plan(f, task, target, tuple(features), key, time) for f in CANDIDATES[task]]


def estimator(
    family: str, task: str, classes: int = 2, weight: str | None = None, **params
) -> Estimator:
    """The Spark ML estimator of a family, on columns `features` and `label`.

    Families that Spark ML fits for two classes only are wrapped one-versus-rest.
    """
    common = {"weightCol": weight} if weight else {}
    if task == "classification":
        makers = {
            "logistic_regression": (cls.LogisticRegression, {}),
            "random_forest": (cls.RandomForestClassifier, {"seed": SEED}),
            "gradient_boosting": (cls.GBTClassifier, {"seed": SEED}),
            "svm": (cls.LinearSVC, {}),
            "decision_tree": (cls.DecisionTreeClassifier, {"seed": SEED}),
            "naive_bayes": (SmoothedBayes, {}),
            "boosted_newton": (BoostedNewton, {"classes": classes}),
        }
    else:
        makers = {
            "linear_regression": (reg.LinearRegression, {}),
            "ridge": (reg.LinearRegression, {"regParam": 1.0, "elasticNetParam": 0.0}),
            "lasso": (reg.LinearRegression, {"regParam": 1.0, "elasticNetParam": 1.0}),
            "elasticnet": (reg.LinearRegression, {"regParam": 1.0, "elasticNetParam": 0.5}),
            "random_forest": (reg.RandomForestRegressor, {"seed": SEED}),
            "gradient_boosting": (reg.GBTRegressor, {"seed": SEED}),
            "decision_tree": (reg.DecisionTreeRegressor, {"seed": SEED}),
            "boosted_newton": (BoostedNewton, {}),
            "svr": (FourierSVR, {}),
        }
    maker, fixed = makers[family]
    single = maker(**{**fixed, **common, **params})
    if task == "classification" and classes > 2 and family in ("gradient_boosting", "svm"):
        return cls.OneVsRest(classifier=single, **common)
    return single
