"""Repeatable pseudo-random numbers that depend on the key only, never on partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_hash(*keys: str | Column, seed: int | str = 42) -> Column:
    """A number in [0, 1) from the key columns and a seed."""
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    digest = F.md5(F.concat(F.concat_ws("|", *parts), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def fold_of(*keys: str | Column, folds: int = 3, seed: int | str = 42) -> Column:
    """Fold number 0 .. folds-1 of a row."""
    return F.floor(unit_hash(*keys, seed=f"fold{seed}") * folds).cast("int")
