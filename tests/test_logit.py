"""Logistic regression searched side by side: the scores are those of Spark's fits one by one, in a few passes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.hashing import fold_of
from plumbline.plans import logit, tuning
from plumbline.plans.families import Plan, estimator
from plumbline.plans.fitting import assembled, with_label
from plumbline.plans.tuning import _evaluator, balanced_folds, draw_params, tune


def mixed(spark, n=900):
    """Two classes that overlap, two columns that almost agree, one that does not vary."""
    rng = np.random.default_rng(5)
    a = rng.gamma(2.0, 300.0, n)
    b = a / 6 + rng.normal(scale=8.0, size=n)
    y = rng.random(n) < 1 / (1 + np.exp(3.0 - a / 300))
    rows = [(i, float(p), float(r), 4.0, "bad" if t else "fine") for i, (p, r, t) in enumerate(zip(a, b, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, same double, y string").repartition(2).persist()


PLAN = Plan("logistic_regression", "classification", "y", ("a", "b", "same"), "id")


@pytest.mark.parametrize("balance", [None, "weights", "synthetic"])
def test_scores_equal_fits_one_by_one(spark, balance):
    df = mixed(spark)
    found = [r["score"] for r in tune(PLAN, df, draws=1, folds=2, balance=balance)[1].collect()]
    for s, score in zip(draw_params(PLAN.family, 1), found):
        parts = []
        for past, test in balanced_folds(PLAN, df, balance, 2):
            past, test = (with_label(assembled(p, list(PLAN.features)), PLAN, ["bad", "fine"]) for p in (past, test))
            weight = "__weight" if balance == "weights" else None
            past = past.select("features", "label", *([weight] if weight else [])).coalesce(1).persist()
            model = estimator(PLAN.family, PLAN.task, 2, weight, tol=1e-10, **s).fit(past)
            parts.append(_evaluator(PLAN.task).evaluate(model.transform(test)))
        assert score == pytest.approx(np.mean(parts), abs=1e-9), s  # the same rows are right


@pytest.mark.parametrize("balance", [None, "weights"])
def test_a_search_takes_few_passes(spark, balance, monkeypatch):
    passes = []
    add = logit.tree_sum
    monkeypatch.setattr(logit, "tree_sum", lambda parts: passes.append(1) or add(parts))
    assert tune(PLAN, mixed(spark), draws=20, balance=balance)[1].count() == 20
    assert 1 <= len(passes) <= 20


def test_one_class_empty_folds_and_more_classes(spark):
    df = mixed(spark, 60)
    fold = fold_of("id", folds=3, seed=42)
    alone = df.withColumn("y", F.when(fold == 0, F.lit("bad")).otherwise("fine"))  # fold 0 is fitted on one class
    table = tune(PLAN, alone, draws=2)[1].collect()
    assert all(0 <= r["score"] <= 1 for r in table)
    with pytest.raises(ValueError, match="empty"):
        tune(PLAN, df.filter(fold != 1), draws=2)
    even = df.withColumn("y", F.expr("IF(id % 2 = 0, 'bad', 'fine')")).withColumn("a", F.lit(1.0)).withColumn("b", F.lit(1.0))
    assert tune(PLAN, even, draws=2, balance="weights")[1].filter("score BETWEEN 0 AND 1").count() == 2
    three = df.withColumn("y", (F.col("id") % 3).cast("string"))
    assert tuning._logit_scores(PLAN, three, three, ["0", "1", "2"], [], 3, 42, None) is None
