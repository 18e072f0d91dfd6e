"""Combining tables by rows, by key, or by the nearest time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import skew
from plumbline.operators.asof import asof_chain, asof_join


def concat_tables(dfs: list[DataFrame]) -> DataFrame:
    """All rows of all tables; columns are matched by name, missing ones are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def suffix_plan(tables: list[list[str]], keep: set[str]) -> list[dict[str, str]]:
    """New names for clashing columns: `_x`/`_y` for two tables, `_1`, `_2`, … beyond."""
    seen: dict[str, int] = {}
    for names in tables:
        for c in names:
            seen[c] = seen.get(c, 0) + 1
    tags = ["_x", "_y"] if len(tables) == 2 else [f"_{i + 1}" for i in range(len(tables))]
    return [
        {c: c + tag for c in names if seen[c] > 1 and c not in keep}
        for names, tag in zip(tables, tags)
    ]


def _hot_over_all(dfs: list[DataFrame], key: str, hot_rows: int | None) -> list[DataFrame | None]:
    return [skew.hot_keys(df.select(f"`{key}`"), [key], hot_rows) for df in dfs]


def join_tables(dfs: list[DataFrame], key: str, hot_rows: int | None = None) -> DataFrame:
    """Full outer join of all tables on one key; a NULL key matches a NULL key."""
    for i, df in enumerate(dfs):
        if key not in df.columns:
            raise ValueError(f"table {i + 1} has no column {key!r}: {df.columns}")
    names = suffix_plan([df.columns for df in dfs], {key})
    tables = [df.withColumnsRenamed(new) for df, new in zip(dfs, names)]
    hot = _hot_over_all(tables, key, hot_rows)
    if any(h is not None for h in hot):
        return _join_sliced(tables, key, hot)
    return reduce(lambda a, b: _full_join(a, b, key), tables)


def _full_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    other = right.withColumnRenamed(key, "__r_key")
    joined = left.join(other, skew.same_keys(left, other, [(key, "__r_key")]), "full")
    return joined.withColumn(key, F.coalesce(f"`{key}`", "__r_key")).drop("__r_key")


def _join_sliced(
    tables: list[DataFrame], key: str, hot: list[DataFrame | None]
) -> DataFrame:
    """The same join with hot keys cut into slices.

    A full outer join cannot be sliced directly: a slice without left rows would
    report its right rows as unmatched. Every table is therefore first completed
    with an empty row for each key it lacks, after which an inner join is exact.
    For each hot key the table with most slices is spread and the others repeat.
    """
    owner = _hot_owner(hot, key)
    presence = reduce(
        DataFrame.unionByName,
        [
            df.select(F.col(f"`{key}`"), F.lit(i).alias("__i")).distinct()
            for i, df in enumerate(tables)
        ],
    )
    present = presence.groupBy(f"`{key}`").agg(F.collect_set("__i").alias("__in"))
    sides = []
    for i, df in enumerate(tables):
        missing = present.filter(~F.array_contains("__in", i)).select(f"`{key}`")
        whole = df.unionByName(missing, allowMissingColumns=True)
        sides.append(_slice_side(whole, owner, i, key))
    joined = reduce(lambda a, b: skew.join_on(a, b, [key, skew.SLICE], "inner"), sides)
    return joined.drop(skew.SLICE)


def _hot_owner(hot: list[DataFrame | None], key: str) -> DataFrame:
    """Hot keys of all tables with the table that is spread for each of them."""
    listed = reduce(
        DataFrame.unionByName,
        [h.withColumn("__owner", F.lit(i)) for i, h in enumerate(hot) if h is not None],
    )
    top = F.max(F.struct(skew.SLICES, "__owner"))
    return listed.groupBy(f"`{key}`").agg(top.alias("__t")).select(f"`{key}`", "__t.*")


def _slice_side(df: DataFrame, owner: DataFrame, i: int, key: str) -> DataFrame:
    flagged = skew.join_on(df, skew.broadcast_if_small(owner, skew.MAX_HOT), [key], "left")
    mine = F.col("__owner") == i
    part = F.pmod(F.spark_partition_id(), F.col(skew.SLICES))
    every = F.sequence(F.lit(0), F.coalesce(F.col(skew.SLICES), F.lit(1)) - 1)
    return (
        flagged.withColumn("__part", part)
        .withColumn(skew.SLICE, F.explode(F.when(mine, F.array("__part")).otherwise(every)))
        .drop("__owner", "__part", skew.SLICES)
    )


def combine(dfs: list[DataFrame], strategy: str = "concat", **params) -> DataFrame:
    """Combine tables by 'concat', 'join' (key) or 'time' (nearest time).

    'time' uses the first two tables when time columns are given, and chains all
    tables on `__datetime` otherwise.
    """
    if not dfs:
        raise ValueError("nothing to combine")
    if len(dfs) == 1:
        return dfs[0]
    if strategy == "concat":
        return concat_tables(dfs)
    if strategy == "join":
        key = (params.get("key") or "").strip()
        if not key:
            raise ValueError("'join' needs key")
        return join_tables(dfs, key)
    if strategy == "time":
        options = {
            "direction": params.get("direction", "nearest"),
            "tolerance_seconds": params.get("tolerance_seconds"),
        }
        left_time = (params.get("left_time") or "").strip()
        right_time = (params.get("right_time") or "").strip()
        if not left_time and not right_time:
            return asof_chain(dfs, **options)
        if not (left_time and right_time):
            raise ValueError("'time' needs left_time and right_time")
        return asof_join(dfs[0], dfs[1], left_time, right_time, **options)
    raise ValueError(f"unknown strategy {strategy!r}")
