"""As-of join: each left row meets the right row nearest in time.

Both sides are first reduced to one row per (key, time), so many rows at one
instant cost nothing later. The reduced rows are cut into time buckets of equal
size; a window finds the match inside each bucket, and the last (or first) right
row of the neighbouring buckets is carried over. The matches are then looked up
by every left row.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.times import as_time, micros
from plumbline.operators import skew

BUCKET_ROWS = 250_000
# more buckets would not make more tasks; a larger bucket still streams through its window
MAX_BUCKETS = 100_000
CUT_ROWS = 20
DIRECTIONS = ("backward", "forward", "nearest")


def prepare_time(
    df: DataFrame, col: str, side: str = "table", fmt: str | None = None
) -> tuple[DataFrame, int]:
    """Parse the time column, drop rows without a time, refuse an empty result.

    Also returns the number of rows, which tells apart all the rest that depends on it.
    """
    if col not in df.columns:
        raise ValueError(f"{side}: no column {col!r} in {df.columns[:10]}")
    timed = df.withColumn(col, as_time(df, col, fmt)).dropna(subset=[col])
    n = timed.select(f"`{col}`").count()
    if not n:
        raise ValueError(f"{side}: no row of {col!r} holds a valid time")
    return timed, n


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    direction: str = "nearest",
    tolerance_seconds: float | None = None,
    by: list[str] | None = None,
    tiebreak: list[str] | None = None,
    bucket_rows: int = BUCKET_ROWS,
    hot_rows: int | None = None,
    fmt: str | None = None,
) -> DataFrame:
    """Attach to every left row the nearest right row in the given direction.

    `nearest` prefers the earlier row on equal gaps. The tolerance is inclusive;
    0 or None means no limit. Among right rows at one time, backward takes the last
    by `tiebreak` and forward the first (default: all right columns). Left rows
    without a valid time are dropped (`times.without_time` counts them); `fmt` is the
    format of text times.
    """
    by = list(by or [])
    left, n_left = prepare_time(left, left_time, "left", fmt)
    right, n_right = prepare_time(right, right_time, "right", fmt)
    buckets = math.ceil((n_left + n_right) / bucket_rows)
    matches, payload = _matches(
        left, right, left_time, right_time, direction, tolerance_seconds, by, tiebreak, buckets, n_left + n_right
    )
    hot = skew.hot_keys(left, [*by, left_time], hot_rows, n_left)
    joined = skew.lookup_join(left, matches, [*by, left_time], "left", hot)
    return _with_payload(joined, left.columns, payload)


def asof_chain(
    dfs: list[DataFrame],
    direction: str = "nearest",
    tolerance_seconds: float | None = None,
    time_col: str = "__datetime",
    tiebreak: list[str] | None = None,
    bucket_rows: int = BUCKET_ROWS,
    hot_rows: int | None = None,
    fmt: str | None = None,
) -> DataFrame:
    """As-of join of the first table with each following one on `time_col`.

    `__source` of table i becomes `__source_i` first, so every origin stays visible.
    The left times never change, so each step matches against the first table's.
    """
    tables = [
        df.withColumnRenamed("__source", f"__source_{i + 1}") for i, df in enumerate(dfs)
    ]
    for i, df in enumerate(tables):
        if time_col not in df.columns:
            raise ValueError(f"table {i + 1} has no {time_col!r}; its columns: {df.columns[:10]}")
    left, n_left = prepare_time(tables[0], time_col, "table 1", fmt)
    result, hot = left, skew.hot_keys(left, [time_col], hot_rows, n_left)
    for i, right in enumerate(tables[1:], start=2):
        right, n_right = prepare_time(right, time_col, f"table {i}", fmt)
        total = n_left + n_right
        buckets = math.ceil(total / bucket_rows)
        matches, payload = _matches(
            left, right, time_col, time_col, direction, tolerance_seconds, [], tiebreak, buckets, total
        )
        joined = skew.lookup_join(result, matches, [time_col], "left", hot)
        result = _with_payload(joined, result.columns, payload)
    return result


def _matches(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    direction: str,
    tolerance_seconds: float | None,
    by: list[str],
    tiebreak: list[str] | None,
    buckets: int,
    total: int,
) -> tuple[DataFrame, list[str]]:
    """One row per left (key, time) with the matched right row as struct `__m`."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    keep = [c for c in right.columns if c not in by and not (c == right_time == left_time)]
    order = F.struct(*[F.col(f"`{c}`") for c in (tiebreak or _orderable(right, keep))])
    payload = F.struct(
        *[F.col(f"`{c}`") for c in keep], F.col(f"`{right_time}`").alias("__rt")
    )
    keys = [F.col(f"`{c}`") for c in by]
    nothing = F.lit(None)
    asked = left.select(
        *keys, F.col(f"`{left_time}`").alias("__t"), nothing.alias("__p"), nothing.alias("__o")
    )
    found = right.select(
        *keys, F.col(f"`{right_time}`").alias("__t"), payload.alias("__p"), order.alias("__o")
    )
    picks = {"__last": F.max_by("__p", "__o"), "__first": F.min_by("__p", "__o")}
    if direction != "nearest":
        del picks["__first" if direction == "backward" else "__last"]
    instants = asked.unionByName(found).groupBy(*by, "__t").agg(
        F.max(F.col("__p").isNull()).alias("__asked"), *[p.alias(c) for c, p in picks.items()]
    )
    instants, buckets = _bucketed(instants, left, right, left_time, right_time, buckets, total)
    seen = _nearest_seen(instants, by, buckets, list(picks)).filter("__asked")

    gaps = {
        "__last": micros("__t") - micros(F.col("__last.__rt")) if "__last" in picks else None,
        "__first": micros(F.col("__first.__rt")) - micros("__t") if "__first" in picks else None,
    }
    if direction == "nearest":
        earlier = F.col("__first").isNull() | (gaps["__last"] <= gaps["__first"])
        match = F.when(earlier, F.col("__last")).otherwise(F.col("__first"))
        gap = F.when(earlier, gaps["__last"]).otherwise(gaps["__first"])
    else:
        (only,) = picks
        match, gap = F.col(only), gaps[only]
    if tolerance_seconds:
        match = F.when(gap <= int(round(tolerance_seconds * 1_000_000)), match)
    return seen.select(*keys, F.col("__t").alias(left_time), match.alias("__m")), keep


def _orderable(df: DataFrame, cols: list[str]) -> list[str]:
    unordered = (T.MapType, T.VariantType)
    return [c for c in cols if not isinstance(df.schema[c].dataType, unordered)] or cols


def _bucketed(
    instants: DataFrame,
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    wanted: int,
    total: int,
) -> tuple[DataFrame, int]:
    """Number time buckets of about equal size; one bucket needs no cuts."""
    wanted = min(MAX_BUCKETS, wanted)
    if wanted <= 1:
        return instants.withColumn("__b", F.lit(0)), 1
    at = micros("__t").cast("double")
    all_times = left.select(F.col(f"`{left_time}`").alias("__t")).unionByName(
        right.select(F.col(f"`{right_time}`").alias("__t"))
    )
    # the cuts only balance the work: any cuts give the same matches, so a few times per
    # bucket do, 2 million at most
    some = all_times.sample(min(1.0, wanted * CUT_ROWS / total), seed=42).select(at.alias("at"))
    times = np.sort([r["at"] for r in some.collect()])
    cuts = times[np.arange(1, wanted) * len(times) // wanted] if len(times) else []
    splits = [-math.inf, *np.unique(cuts).tolist(), math.inf]
    bucketizer = Bucketizer(splits=splits, inputCol="__at", outputCol="__b")
    numbered = bucketizer.transform(instants.withColumn("__at", at)).drop("__at")
    return numbered.withColumn("__b", F.col("__b").cast("int")), len(splits) - 1


def _nearest_seen(
    instants: DataFrame, by: list[str], buckets: int, cols: list[str]
) -> DataFrame:
    """Fill `__last` from the rows before and `__first` from the rows after, across buckets."""
    # frames that end at the current row cost one step per row; frames that begin there do not
    def latest(col: str, cut: list[str], order: Column, end: int) -> Column:
        frame = Window.partitionBy(*cut).orderBy(order).rowsBetween(Window.unboundedPreceding, end)
        return F.last(col, ignorenulls=True).over(frame)

    toward = {
        c: lambda key, c=c: F.col(key).asc() if c == "__last" else F.col(key).desc() for c in cols
    }
    near = {c: latest(c, [*by, "__b"], toward[c]("__t"), 0) for c in cols}
    seen = instants.withColumns(near)
    if buckets == 1:
        return seen
    # one row per bucket and key from here on, so these windows do not grow with the data
    edge = {"__last": F.max_by, "__first": F.min_by}
    edges = instants.groupBy(*by, "__b").agg(
        *[edge[c](c, F.when(F.col(c).isNotNull(), F.col("__t"))).alias(c) for c in cols],
        F.max("__asked").alias("__asked"),
    )
    carry = edges.select(
        *by, "__b", "__asked", *[latest(c, by, toward[c]("__b"), -1).alias(f"_{c}") for c in cols]
    )
    # only buckets with left rows need it; asking also keeps this branch's input equal to
    # that of the windows above, so both read one shuffle
    carry = carry.filter("__asked").drop("__asked")
    found = skew.join_on(seen, carry, [*by, "__b"], "left")
    return found.withColumns({c: F.coalesce(c, f"_{c}") for c in cols}).drop(*[f"_{c}" for c in cols])


def _with_payload(joined: DataFrame, left_cols: list[str], right_cols: list[str]) -> DataFrame:
    """Left columns and the matched right ones; clashing names get `_x` and `_y`."""
    clash = set(left_cols) & set(right_cols)
    taken = (set(left_cols) | set(right_cols)) - clash

    def renamed(name: str, tag: str) -> Column | str:
        out = name
        while out in clash or (out != name and out in taken):
            out += tag
        return out

    return joined.select(
        *[F.col(f"`{c}`").alias(renamed(c, "_x")) for c in left_cols],
        *[F.col("__m").getField(c).alias(renamed(c, "_y")) for c in right_cols],
    )
