"""Audits of splits, folds and evaluations on the data itself.

Every audit returns one row (audit, level, detail, n): the number of offending rows,
`critical` when there are any. Keys are reduced to one row per key before any join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import skew
from plumbline.operators.profile import q
from plumbline.operators.split import SEED, TEST_SHARE, split_random


def _finding(counted: DataFrame, audit: str, detail: str) -> DataFrame:
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    return counted.select(
        F.lit(audit).alias("audit"),
        F.when(n > 0, "critical").otherwise("ok").alias("level"),
        F.lit(detail).alias("detail"),
        n.alias("n"),
    )


def _per_key(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(q(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))


def _rows_matching(df: DataFrame, other: DataFrame, key: str, how: str) -> DataFrame:
    """Rows of `df` whose key is (left_semi) or is not (left_anti) in `other`."""
    mine, theirs = _per_key(df, key), other.select(q(key).alias("__k")).distinct()
    return skew.join_on(mine, theirs, ["__k"], how).agg(F.sum("__n").alias("n"))


def audit_leakage(
    train: DataFrame, test: DataFrame, key: str, origin: str | None = None
) -> DataFrame:
    """Test rows whose key is also in training.

    With `origin`, the key a synthetic training row was made from, also synthetic
    rows that do not derive from a training row.
    """
    leaked = _finding(_rows_matching(test, train, key, "left_semi"), "leakage", "test rows in train")
    if origin is None:
        return leaked
    made = train.filter(q(origin).isNotNull()).select(q(origin).alias(key))
    real = train.filter(q(origin).isNull())
    foreign = _rows_matching(made, real, key, "left_anti")
    return leaked.unionByName(
        _finding(foreign, "leakage", "synthetic rows not derived from train")
    )


def audit_cv(folds: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """Fold rows that are not training rows."""
    return _finding(
        _rows_matching(folds, train, key, "left_anti"), "cv_integrity", "fold rows outside train"
    )


def audit_oversample(
    test: DataFrame, synthetic: str, task: str = "classification"
) -> DataFrame:
    """Synthetic rows in the test part; only classification oversamples."""
    flagged = F.count_if(q(synthetic)) if task == "classification" else F.lit(0)
    return _finding(
        test.agg(flagged.alias("n")), "oversample_order", "synthetic rows in test"
    )


def audit_eval(preds: DataFrame, train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Predictions made for training rows while no test row has one."""
    on_train = _rows_matching(preds, train, key, "left_semi").select(
        F.lit("train").alias("part"), "n"
    )
    on_test = _rows_matching(preds, test, key, "left_semi").select(F.lit("test").alias("part"), "n")
    both = on_train.unionByName(on_test).agg(
        F.max(F.when(F.col("part") == "train", F.col("n"))).alias("on_train"),
        F.max(F.when(F.col("part") == "test", F.col("n"))).alias("on_test"),
    )
    only_train = F.when(F.coalesce("on_test", F.lit(0)) == 0, F.col("on_train"))
    return _finding(both.select(only_train.alias("n")), "evaluation", "predictions on train only")


def audit_time_split(
    train: DataFrame, test: DataFrame, time: str, task: str = "timeseries"
) -> DataFrame:
    """Training rows later than the first test row; only for time series."""
    first = test.agg(F.min(q(time))).first()[0]
    if task != "timeseries" or first is None:
        late: Column = F.lit(0)
    else:
        late = F.count_if(q(time) > F.lit(first).cast(train.schema[time].dataType))
    return _finding(train.agg(late.alias("n")), "time_split", "train rows after first test row")


def audit_repro(
    df: DataFrame,
    stored: DataFrame,
    key: str,
    seed: int = SEED,
    test: float = TEST_SHARE,
    part: str = "part",
) -> DataFrame:
    """Rows whose recomputed part differs from the stored one, or that lack one."""
    again = split_random(df, key, test, seed, "__part").select(
        q(key).alias("k"), F.col("__part").alias("part"), F.lit(1).alias("sign")
    )
    kept = stored.select(q(key).alias("k"), q(part).alias("part"), F.lit(-1).alias("sign"))
    differing = again.unionByName(kept).groupBy("k", "part").agg(F.sum("sign").alias("d"))
    missing = F.sum(F.greatest("d", F.lit(0)))
    extra = F.sum(F.greatest(-F.col("d"), F.lit(0)))
    return _finding(
        differing.agg(F.greatest(missing, extra).alias("n")), "reproducibility", "rows split differently"
    )


def run_audits(
    df: DataFrame,
    key: str,
    train: DataFrame,
    test: DataFrame,
    task: str = "classification",
    folds: DataFrame | None = None,
    preds: DataFrame | None = None,
    synthetic: str | None = None,
    origin: str | None = None,
    time: str | None = None,
    seed: int = SEED,
    part: str = "part",
) -> DataFrame:
    """Every audit that applies to the task and for which data is given."""
    found = [audit_leakage(train, test, key, origin)]
    if folds is not None:
        found.append(audit_cv(folds, train, key))
    if synthetic is not None and task == "classification":
        found.append(audit_oversample(test, synthetic, task))
    if preds is not None:
        found.append(audit_eval(preds, train, test, key))
    if task == "timeseries" and time is not None:
        found.append(audit_time_split(train, test, time, task))
    if task != "timeseries":
        real = train.filter(~F.coalesce(q(synthetic), F.lit(False))) if synthetic else train
        stored = real.select(q(key), q(part)).unionByName(test.select(q(key), q(part)))
        found.append(audit_repro(df, stored, key, seed, part=part))
    return reduce(DataFrame.unionByName, found)
