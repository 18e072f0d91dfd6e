"""Exact evaluation metrics, for one run or for many at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.profile import q


def classification_metrics(
    preds: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    by: list[str] | None = None,
) -> DataFrame:
    """Accuracy, class-weighted F1 and row count from confusion counts."""
    by = by or []
    cells = preds.groupBy(*by, q(label).alias("__y"), q(prediction).alias("__p")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    hit = F.when(F.col("__y") == F.col("__p"), F.col("__n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    roles = F.array(
        F.struct(
            F.col("__y").cast("string").alias("c"),
            F.col("__n").alias("support"),
            zero.alias("predicted"),
            hit.cast("bigint").alias("tp"),
        ),
        F.struct(
            F.col("__p").cast("string").alias("c"),
            zero.alias("support"),
            F.col("__n").alias("predicted"),
            zero.alias("tp"),
        ),
    )
    classes = (
        cells.select(*by, F.inline(roles))
        .groupBy(*by, "c")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    )
    f1 = F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted"))
    return classes.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1"),
        F.sum("support").alias("n_test"),
    )


def regression_metrics(
    preds: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    by: list[str] | None = None,
) -> DataFrame:
    """RMSE, MAE, R² and row count; R² of a constant label is 1 or 0."""
    error = q(label).cast("double") - q(prediction).cast("double")
    sums = preds.groupBy(*(by or [])).agg(
        F.avg(error * error).alias("__mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop(q(label).cast("double")).alias("__var"),
        F.count(error).alias("n_test"),
    )
    constant = F.when(F.col("__mse") == 0, 1.0).otherwise(0.0)
    r2 = F.when(F.col("__var") > 0, 1 - F.col("__mse") / F.col("__var")).otherwise(constant)
    return sums.select(
        *(by or []), F.sqrt("__mse").alias("rmse"), "mae", r2.alias("r2"), "n_test"
    )
