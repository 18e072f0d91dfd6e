"""Fit, diagnose, remedy and fit again, for a few rounds."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import DataFrame

from plumbline.operators import prepare as prep
from plumbline.operators.diagnose import (
    ACCURACY,
    ACCURACY_TOO_LOW,
    COLLINEARITY,
    IMBALANCE,
    R2,
    R2_NEGATIVE,
    R2_TOO_LOW,
    RUN_COLUMNS,
    TRUSTED,
    diagnose,
)
from plumbline.operators.leaderboard import MAX_ROUNDS, best_run, run_score
from plumbline.operators.metrics import classification_metrics, regression_metrics
from plumbline.operators.profile import class_distribution, high_corr_pairs, q
from plumbline.plans.families import CANDIDATES, Plan
from plumbline.plans.fitting import Fitted, fit, importance
from plumbline.plans.tuning import DRAWS, FOLDS, WEIGHT, balanced, tune

FIT_ERRORS = (ValueError, AnalysisException, IllegalArgumentException)  # what data can cause
WEAK = {ACCURACY, ACCURACY_TOO_LOW, R2, R2_NEGATIVE, R2_TOO_LOW}
RUN_SCHEMA = (
    "session_id string, round int, task string, family string, remedy string, ok boolean, error string, "
    "derived_features array<string>, best_params map<string,string>, cv_score double, accuracy double, f1 double, rmse double, mae double, r2 double, n_train bigint, n_test bigint, "
    + ", ".join(
        f"{c} {kind}"
        for c, kind in RUN_COLUMNS.items()
        if c not in ("n_train", "n_test", "accuracy", "r2")
    )
)


def evaluate(fitted: Fitted, test: DataFrame) -> dict:
    """Metrics of a fitted plan on the test part."""
    preds = fitted.predict(test)
    if fitted.plan.task == "classification":
        return classification_metrics(preds).first().asDict()
    return regression_metrics(preds).first().asDict()


def run_row(
    plan: Plan, train: DataFrame, test: DataFrame, weight: str | None = None,
    real: DataFrame | None = None,
) -> dict:
    """Fit once and describe the run as the diagnosis wants it.

    `train` may hold synthetic rows, `real` does not. Correlations are those of all
    real rows, training and test.
    """
    real = train if real is None else real
    fitted = fit(plan, train, weight)
    row = {**evaluate(fitted, test), "n_train": real.count(), "ok": True}
    found = importance(fitted)
    row["feature_importance"] = (
        {r["feature"]: r["importance"] for r in found.collect()} if found is not None else None
    )
    every = real.unionByName(test, allowMissingColumns=True)
    features = every.select(*[q(c) for c in plan.features])
    row["high_correlation_pairs"] = [tuple(r) for r in high_corr_pairs(features).collect()]
    if plan.task == "classification":
        dist = class_distribution(every, plan.target)
        row["class_distribution"] = {r["label"]: r["n"] for r in dist.collect()}  # one per class
    return row


def improve(
    plan: Plan, train: DataFrame, test: DataFrame, session: str = "session", rounds: int = MAX_ROUNDS,
    draws: int = DRAWS, folds: int = FOLDS, preprocessing: tuple[str, ...] = (), derived: tuple[str, ...] = (),
) -> DataFrame:
    """Diagnosed runs, one row per round, until trusted or at most `rounds` rounds.

    Every round first searches settings (`draws` of them, 0 for none; not for knn) on rows
    balanced as those it then fits, fold by fold. Each round answers the checks of the one
    before: class weights, then synthetic rows for imbalance, dropping collinear columns, a
    stronger family for weak scores. What was done is in `preprocessing`; the mitigation checks
    read it there. A round whose data do not allow a fit is a failed run with its message;
    failures of the engine are not caught.
    """
    spark = train.sparkSession
    train, test = train.persist(), test.persist()  # read by every round, search and count
    try:
        tables, remedy, balance = [], "none", None
        names = spark.createDataFrame([], RUN_SCHEMA).columns
        steps_done = list(preprocessing)
        succeeded = False
        for i in range(1, rounds + 1):
            values = {
                "session_id": session, "round": i, "task": plan.task, "family": plan.family, "remedy": remedy,
                "preprocessing": steps_done, "derived_features": list(derived), "smote": balance == "synthetic", "balanced": balance == "weights",
            }
            try:
                if draws and plan.family != "knn":
                    plan, searched = tune(plan, train, draws, folds, balance=balance)
                    values["cv_score"] = searched.filter("best").first()["score"]
                    values["best_params"] = {k: str(v) for k, v in plan.params.items()}
                weight = WEIGHT if balance == "weights" else None
                values.update(run_row(plan, balanced(plan, train, balance), test, weight, train))
            except FIT_ERRORS as error:  # a failed round is a result too
                values.update(ok=False, error=f"{type(error).__name__}: {error}"[:500])
            run = spark.createDataFrame([tuple(values.get(c) for c in names)], RUN_SCHEMA)
            run = run_score(diagnose(run))
            tables.append(run)
            seen = run.select("ok", "verdict", "checks").first()
            if seen["verdict"] == TRUSTED and seen["ok"] or (not seen["ok"] and succeeded):
                break
            succeeded = succeeded or seen["ok"]
            failed = {c["item"] for c in seen["checks"] if c["level"] != "ok"}
            steps = []
            if IMBALANCE in failed and plan.task == "classification":
                if balance != "weights" and plan.family != "knn":
                    balance = "weights"
                    steps.append("class weights")
                    steps_done = [*steps_done, "balanced class weights"]
                else:
                    balance = "synthetic"
                    steps.append("synthetic rows")
                    steps_done = [*steps_done, "SMOTE"]
            if COLLINEARITY in failed:
                columns = train.unionByName(test).select(*[q(c) for c in plan.features])
                kept = prep.drop_collinear(columns, high_corr_pairs(columns)).columns
                plan = replace(plan, features=tuple(c for c in plan.features if c in kept))
                steps.append("drop collinear")
                steps_done = [*steps_done, "collinear columns dropped"]
            if failed & WEAK or not seen["ok"]:
                plan = replace(plan, family=_stronger(plan), params={})
                steps.append("stronger family")
            remedy = ", ".join(steps) or "none"
        return reduce(DataFrame.unionByName, tables)
    finally:
        train.unpersist()
        test.unpersist()


def _stronger(plan: Plan) -> str:
    order = CANDIDATES[plan.task]
    at = order.index(plan.family) if plan.family in order else -1
    return order[min(at + 1, len(order) - 1)]


def best_of(runs: DataFrame, rounds: int | None = None) -> DataFrame:
    """The best run of each session, of all recorded rounds unless limited."""
    return best_run(runs, ["session_id"], rounds)
