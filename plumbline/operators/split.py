"""Repeatable train/test splits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import unit_hash
from plumbline.functions.times import micros
from plumbline.operators.order import nth_value
from plumbline.operators.profile import q
from plumbline.operators.series import time_order

TEST_SHARE = 0.2
SEED = 42


def split_random(
    df: DataFrame, key: str, test: float = TEST_SHARE, seed: int = SEED, part: str = "part"
) -> DataFrame:
    """Mark rows 'train' or 'test' by a hash of the key, the same on every run."""
    return df.withColumn(
        part, F.when(unit_hash(q(key), seed=seed) < test, "test").otherwise("train")
    )


def cut_time(df: DataFrame, time: str, test: float = TEST_SHARE) -> int | None:
    """Time in microseconds of the last training row of a chronological split."""
    at = df.select(micros(q(time)).alias("at"))
    n = at.filter("at IS NOT NULL").count()
    n_train = n - math.ceil(round(n * test, 9))
    return nth_value(at, "at", n_train - 1) if n_train else None


def split_time(
    df: DataFrame, time: str, test: float = TEST_SHARE, part: str = "part", fmt: str | None = None
) -> DataFrame:
    """Mark the last share of rows by time 'test'; ties at the cut stay 'train'.

    Rows without a valid time are dropped; `fmt` is the format of text times.
    """
    df = time_order(df, time, fmt)
    cut = cut_time(df, time, test)
    late = F.lit(True) if cut is None else micros(q(time)) > cut
    return df.withColumn(part, F.when(late, "test").otherwise("train"))
