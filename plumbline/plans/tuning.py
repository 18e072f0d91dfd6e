"""Seeded random search with cross-validation on repeatable folds."""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator
from dataclasses import replace
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import fold_of
from plumbline.functions.times import micros
from plumbline.operators import prepare as prep
from plumbline.operators.order import nth_values
from plumbline.operators.oversample import smote
from plumbline.operators.profile import q
from plumbline.plans import grams, logit
from plumbline.plans.families import SEARCH, SEED, Plan, Range, estimator
from plumbline.plans.fitting import assembled, class_labels, with_label

DRAWS = 20
FOLDS = 3
WEIGHT = "__weight"
BALANCES = (None, "weights", "synthetic")
RESULT = "draw int, params string, score double, best boolean"


def draw_params(family: str, draws: int = DRAWS, seed: int = SEED) -> list[dict]:
    """Different settings: drawn from the family's ranges, or from all combinations of its values."""
    space, rng = SEARCH[family], random.Random(seed)
    if not any(isinstance(values, Range) for values in space.values()):
        grid = [dict(zip(space, values)) for values in itertools.product(*space.values())]
        return rng.sample(grid, min(draws, len(grid)))
    return [{name: v.draw(rng) if isinstance(v, Range) else rng.choice(v) for name, v in space.items()} for _ in range(draws)]


def _evaluator(task: str):
    if task == "classification":
        return MulticlassClassificationEvaluator(metricName="accuracy")
    return RegressionEvaluator(metricName="r2")


def tune(
    plan: Plan,
    train: DataFrame,
    draws: int = DRAWS,
    folds: int = FOLDS,
    seed: int = SEED,
    parallelism: int = 4,
    balance: str | None = None,
) -> tuple[Plan, DataFrame]:
    """The plan with its best settings, and one row (draw, params, score, best) per draw.

    Folds are a hash of the key. For time series each fold is tested after the times
    it was trained on, never before. Linear families take one pass for all settings and folds,
    logistic regression on two classes a few (`logit`).
    With `balance` (weights, synthetic; classification only) the rows to fit on are balanced
    fold by fold, from the other folds alone, and the scores are those of real rows.
    """
    if plan.family == "knn":
        raise ValueError("knn has no settings to search")
    if balance not in BALANCES or (balance and plan.task != "classification"):
        raise ValueError(f"balance must be one of {BALANCES}, and only classes are balanced")
    spark = train.sparkSession
    settings = draw_params(plan.family, draws, seed)
    labels = class_labels(train, plan.target) if plan.task == "classification" else []
    rows = with_label(assembled(train, list(plan.features), plan.family), plan, labels)
    if plan.family in grams.FAMILIES:
        forward = plan.task == "timeseries"
        dealt = forward_folds(rows, plan.time, folds) if forward else rows.withColumn("fold", fold_of(plan.key, folds=folds, seed=seed))
        pairs = [(list(range(i)), i) for i in range(1, folds + 1)] if forward else [
            ([j for j in range(folds) if j != i], i) for i in range(folds)
        ]
        scores = grams.scores(dealt.select("features", "label", F.col("fold").cast("int")), plan.family, settings, pairs)
    elif (found := _logit_scores(plan, train, rows, labels, settings, folds, seed, balance)) is not None:
        scores = found
    elif balance:
        scores = _balanced_scores(plan, train, labels, settings, folds, seed, balance, parallelism)
    elif plan.task == "timeseries":
        scores = _forward_scores(plan, rows, settings, folds)
    else:
        rows = rows.select("features", "label", fold_of(plan.key, folds=folds, seed=seed).alias("fold"))
        rows = rows.persist()
        model = estimator(plan.family, plan.task, len(labels))
        inner = model.getClassifier() if hasattr(model, "getClassifier") else model
        maps = [{inner.getParam(p): v for p, v in s.items()} for s in settings]
        search = CrossValidator(
            estimator=model, estimatorParamMaps=maps, evaluator=_evaluator(plan.task),
            numFolds=folds, foldCol="fold", parallelism=parallelism,
        )
        try:
            scores = [float(x) for x in search.fit(rows).avgMetrics]
        finally:
            rows.unpersist()
    best = max(range(len(settings)), key=lambda i: scores[i])
    table = spark.createDataFrame(
        [(i, str(s), scores[i], i == best) for i, s in enumerate(settings)], RESULT
    )
    return replace(plan, params=settings[best]), table


def balanced(plan: Plan, rows: DataFrame, balance: str | None) -> DataFrame:
    """The rows with class weights in `__weight`, or with synthetic rows; nothing else is looked at."""
    if balance == "weights":
        return prep.class_weights(rows, plan.target, WEIGHT)
    return smote(rows, list(plan.features), plan.target, plan.key) if balance == "synthetic" else rows


def balanced_folds(
    plan: Plan, train: DataFrame, balance: str | None, folds: int = FOLDS, seed: int = SEED
) -> Iterator[tuple[DataFrame, DataFrame]]:
    """For each fold the other folds' rows, balanced by themselves, and its own rows as they are."""
    fold = fold_of(plan.key, folds=folds, seed=seed)
    for i in range(folds):
        yield balanced(plan, train.filter(fold != i), balance), train.filter(fold == i)


def _logit_scores(
    plan: Plan, train: DataFrame, rows: DataFrame, labels: list, settings: list[dict], folds: int, seed: int, balance: str | None
) -> list[float] | None:
    """Scores of logistic regression on two classes, all settings and folds side by side; None for others."""
    if plan.family != logit.FAMILY or len(labels) != 2 or None in labels:
        return None
    if balance != "synthetic":  # class weights follow from the sizes of the classes
        dealt = rows.select("features", "label", fold_of(plan.key, folds=folds, seed=seed).alias("fold"))
        pairs = [([j for j in range(folds) if j != i], i) for i in range(folds)]

        def level(i: int) -> float:
            past = next(itertools.islice(balanced_folds(plan, train, balance, folds, seed), i, None))[0]
            past = with_label(assembled(past, list(plan.features), plan.family), plan, labels).select("features", "label", WEIGHT)
            return estimator(plan.family, plan.task, 2, WEIGHT, regParam=1.0, elasticNetParam=1.0).fit(past).intercept

        return logit.scores(dealt, settings, pairs, balance == "weights", level if balance else None)
    parts = [part for pair in balanced_folds(plan, train, balance, folds, seed) for part in pair]
    dealt = [
        with_label(assembled(part, list(plan.features), plan.family), plan, labels).select("features", "label", F.lit(i).alias("fold"))
        for i, part in enumerate(parts)
    ]
    return logit.scores(reduce(DataFrame.unionByName, dealt), settings, [([2 * i], 2 * i + 1) for i in range(folds)])


def _balanced_scores(
    plan: Plan, train: DataFrame, labels: list, settings: list[dict], folds: int, seed: int, balance: str, parallelism: int
) -> list[float]:
    weight = WEIGHT if balance == "weights" else None
    totals = [0.0] * len(settings)
    for parts in balanced_folds(plan, train, balance, folds, seed):
        past, test = (with_label(assembled(p, list(plan.features), plan.family), plan, labels) for p in parts)
        past = past.select("features", "label", *([weight] if weight else [])).persist()
        test = test.select("features", "label").persist()

        def score(setting: dict) -> float:
            model = estimator(plan.family, plan.task, len(labels), weight, **setting).fit(past)
            return _evaluator(plan.task).evaluate(model.transform(test))

        try:
            with ThreadPool(min(parallelism, len(settings))) as pool:
                totals = [t + s for t, s in zip(totals, pool.map(score, settings))]
        finally:
            past.unpersist()
            test.unpersist()
    return [t / folds for t in totals]


def forward_folds(df: DataFrame, time: str, folds: int = FOLDS) -> DataFrame:
    """Add `fold` 0 .. folds by time in equal shares; fold i is tested after 0 .. i-1."""
    at = df.select(micros(q(time)).alias("at"))
    n = at.count()
    places = [n * i // (folds + 1) for i in range(1, folds + 1)]
    found = nth_values(at, {"at": places})
    cuts = [found["at", p] for p in places]
    fold = sum(((micros(q(time)) >= c).cast("int") for c in cuts[1:]), (micros(q(time)) >= cuts[0]).cast("int"))
    return df.withColumn("fold", fold)


def _forward_scores(plan: Plan, rows: DataFrame, settings: list[dict], folds: int) -> list[float]:
    rows = forward_folds(rows, plan.time, folds).select("features", "label", "fold").persist()
    totals = [0.0] * len(settings)
    try:
        for i in range(1, folds + 1):
            past, next_part = rows.filter(F.col("fold") < i), rows.filter(F.col("fold") == i)
            for j, s in enumerate(settings):
                model = estimator(plan.family, plan.task, **s).fit(past)
                totals[j] += _evaluator(plan.task).evaluate(model.transform(next_part))
    finally:
        rows.unpersist()
    return [t / folds for t in totals]
