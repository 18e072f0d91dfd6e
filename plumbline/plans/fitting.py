"""Fitting a plan and predicting with it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import skew
from plumbline.operators.neighbors import nearest
from plumbline.operators.profile import q
from plumbline.plans.families import TAKES_MISSING, Plan, estimator

KNN = 5
MAX_CLASSES = 1000
# Trees of these split by sums of labels alone; settings that count rows are not among the listed ones.
BY_MEANS = ("decision_tree", "gradient_boosting")
KEPT_BY_MEANS = {"maxIter", "maxDepth", "stepSize"}
FEWER = 0.5
WEIGHT = "__rows"


@dataclass
class Fitted:
    """A fitted plan; `labels` holds the classes in sorted order."""

    plan: Plan
    model: Model | None
    labels: list
    train: DataFrame

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows (key, label, prediction) in the units of the target."""
        plan = self.plan
        if plan.family == "knn":
            return _vote(self, rows)
        scored = self.model.transform(assembled(rows, list(plan.features), plan.family))
        if plan.task == "classification":
            names = F.array(*[F.lit(x) for x in self.labels])
            predicted = F.get(names, F.col("prediction").cast("int"))
        else:
            predicted = F.col("prediction")
        return scored.select(
            q(plan.key), q(plan.target).alias("label"), predicted.alias("prediction")
        )


def assembled(df: DataFrame, features: list[str], family: str | None = None) -> DataFrame:
    """Add `features`; missing values become NaN for families that take them and are an error for others."""
    invalid = "keep" if family in TAKES_MISSING else "error"
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid=invalid).transform(df)


def class_labels(train: DataFrame, target: str, max_classes: int = MAX_CLASSES) -> list:
    """The classes in sorted order; more than `max_classes` is no classification."""
    rows = train.select(q(target)).distinct().orderBy(q(target)).limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"{target!r} has more than {max_classes} classes")
    return [r[0] for r in rows]


def with_label(df: DataFrame, plan: Plan, labels: list) -> DataFrame:
    """Add the numeric `label` Spark ML wants."""
    if plan.task == "classification":
        code = F.array_position(F.array(*[F.lit(x) for x in labels]), q(plan.target)) - 1
        return df.withColumn("label", code.cast("double"))
    return df.withColumn("label", q(plan.target).cast("double"))


def merged(rows: DataFrame) -> DataFrame | None:
    """Rows of equal features as one with the mean of their labels and their number in `__rows`.

    None where that leaves more than half of them, by a sketch. Missing labels stay apart.
    """
    found = rows.agg(F.approx_count_distinct("features").alias("kinds"), F.count(F.lit(1)).alias("n")).first()
    if found["kinds"] > FEWER * found["n"]:
        return None
    groups = rows.groupBy("features", F.col("label").isNull().alias("__missing"))
    means = groups.agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias(WEIGHT))
    return means.select("features", "label", WEIGHT)


def fit(plan: Plan, train: DataFrame, weight: str | None = None) -> Fitted:
    """Fit the plan on complete training rows; families that take missing values need no complete ones.

    Regression trees grow from sums of labels, the same for rows of equal features taken together.
    """
    labels = class_labels(train, plan.target) if plan.task == "classification" else []
    if plan.family == "knn":
        return Fitted(plan, None, labels, train)
    usable = with_label(assembled(train, list(plan.features), plan.family), plan, labels)
    # several passes follow; what does not fit in memory goes to disk
    usable = usable.select("features", "label", *([weight] if weight else []))
    if plan.task != "classification" and plan.family in BY_MEANS and not weight and plan.params.keys() <= KEPT_BY_MEANS:
        fewer = merged(usable)
        usable, weight = (usable, None) if fewer is None else (fewer, WEIGHT)
    usable = usable.persist()
    try:
        model = estimator(plan.family, plan.task, len(labels), weight, **plan.params).fit(usable)
    finally:
        usable.unpersist()
    return Fitted(plan, model, labels, train)


def _vote(fitted: Fitted, rows: DataFrame) -> DataFrame:
    """Majority class of the nearest training rows; ties go to the smaller class."""
    plan = fitted.plan
    base = fitted.train.withColumnRenamed(plan.key, "__base")
    k = plan.params.get("k", KNN)
    near = nearest(rows, base, list(plan.features), k, plan.key, "__base", carry=plan.target)
    votes = near.groupBy(q(plan.key), F.col("carried").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy(q(plan.key)).orderBy(F.desc("n"), "c")
    won = votes.withColumn("r", F.row_number().over(first)).filter("r = 1")
    asked = rows.select(q(plan.key), q(plan.target).alias("label"))
    return skew.join_on(
        asked, won.select(q(plan.key), F.col("c").alias("prediction")), [plan.key], "left"
    )


def importance(fitted: Fitted) -> DataFrame | None:
    """Importance by feature name, for models that have it."""
    values = getattr(fitted.model, "featureImportances", None)
    if values is None:
        return None
    rows = [(name, float(x)) for name, x in zip(fitted.plan.features, values.toArray())]
    return fitted.train.sparkSession.createDataFrame(rows, "feature string, importance double")
