"""Joins that hold when one key owns a large share of the rows.

A key is hot when it has more rows than `HOT_ROWS`, whatever the size of the table.
Rows of a hot key are spread over slices; the other side of the join is repeated once
per slice for the hot keys only. A list of up to MAX_HOT hot keys is broadcast; a longer
one, which takes a table of more than MAX_HOT * HOT_ROWS rows, is joined by shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.durable import materialize

HOT_ROWS = 1_000_000
MAX_HOT = 1024
SKETCH_ROWS = 100_000
SLICE = "__slice"
SLICES = "__slices"


def same_keys(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Join condition that also matches NULL to NULL."""
    return reduce(
        lambda a, b: a & b, [left[f"`{x}`"].eqNullSafe(right[f"`{y}`"]) for x, y in pairs]
    )


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join on equally named keys, NULL matching NULL, keys kept once."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    joined = left.join(renamed, same_keys(left, renamed, [(k, f"__r_{k}") for k in keys]), how)
    return joined.drop(*[f"__r_{k}" for k in keys])


def hot_keys(
    df: DataFrame, keys: list[str], hot_rows: int | None = None, total: int | None = None
) -> DataFrame | None:
    """Keys too big for one task with the number of slices each needs, or None.

    Costs one row count, unless `total` gives it, and, when the table is large enough to hold a hot key at all, a
    count per key; in large tables a sketch, which shuffles next to nothing, first finds
    the likely keys. `hot_rows=0` skips the check, for keys known to be spread evenly.
    """
    if hot_rows == 0:
        return None
    hot_rows = hot_rows or HOT_ROWS
    total = df.count() if total is None else total
    if total <= hot_rows:
        return None
    named = [F.col(f"`{k}`") for k in keys]
    few = total <= MAX_HOT * hot_rows  # then fewer than MAX_HOT keys can be hot
    rows = df
    if few and total > SKETCH_ROWS:
        hashed = F.xxhash64(*named)
        # the sketch overestimates, by less than total / (4 * MAX_HOT): it misses no hot key
        sketch = f"approx_top_k(h, {2 * MAX_HOT}, {8 * MAX_HOT})"
        top = df.select(hashed.alias("h")).agg(F.expr(sketch).alias("top")).first()["top"]
        likely = [r["item"] for r in top if r["count"] > hot_rows]
        if not likely:
            return None
        rows = df.filter(hashed.isin(likely))
    counts = rows.groupBy(*named).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_rows)
    hot = counts.select(*named, F.ceil(F.col("__n") / hot_rows).cast("int").alias(SLICES))
    if not few:
        return materialize(hot)
    found = hot.collect()  # fewer than MAX_HOT rows
    return F.broadcast(df.sparkSession.createDataFrame(found, hot.schema)) if found else None


def spread(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Number the slice of every row.

    The slice follows the input partition, so copies of one row spread too and a
    recomputed task gives every row the same slice again.
    """
    flagged = join_on(df, hot, keys, "left")
    part = F.pmod(F.spark_partition_id(), F.col(SLICES))
    return flagged.withColumn(SLICE, F.coalesce(part, F.lit(0))).drop(SLICES)


def repeat(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """One copy of every row per slice of its key."""
    flagged = join_on(df, hot, keys, "left")
    slices = F.sequence(F.lit(0), F.coalesce(F.col(SLICES), F.lit(1)) - 1)
    return flagged.withColumn(SLICE, F.explode(slices)).drop(SLICES)


def lookup_join(
    left: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    how: str = "left",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join `left` to a table with one row per key, slicing the `hot` keys of `left`."""
    if hot is None:
        return join_on(left, lookup, keys, how)
    joined = join_on(spread(left, hot, keys), repeat(lookup, hot, keys), [*keys, SLICE], how)
    return joined.drop(SLICE)


def broadcast_if_small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Broadcast hint for a table counted to have at most `max_rows` rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
