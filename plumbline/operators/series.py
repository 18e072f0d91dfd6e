"""Time-series features: lags, rolling statistics and calendar parts.

With keys of moderate size a keyed window does the work. Without keys, or when one
key is hot, the rows get an exact global index and are cut into chunks of equal
size; each chunk also receives the last few rows of the chunk before it, so every
window sees its history and no task sees more than one chunk.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from plumbline.functions.times import as_time, calendar_columns
from plumbline.operators import skew
from plumbline.operators.order import global_index
from plumbline.operators.profile import q

CHUNK_ROWS = 100_000
LAGS = (1, 2, 3, 7)
WINDOWS = (3, 7)

History = Callable[[WindowSpec, Callable[[int], Column]], dict[str, Column]]


def time_order(df: DataFrame, time: str, fmt: str | None = None) -> DataFrame:
    """Parse the time column and drop rows without a time; windows sort by it."""
    return df.withColumn(time, as_time(df, time, fmt)).dropna(subset=[time])


def with_history(
    df: DataFrame,
    order: list[str],
    by: list[str],
    reach: int,
    build: History,
    chunk_rows: int = CHUNK_ROWS,
    hot_rows: int | None = None,
) -> DataFrame:
    """Add window columns that look at most `reach` rows back within each key.

    `build(window, same)` returns the new columns; `same(k)` tells whether the row
    k steps back belongs to the same key.
    """
    if by and skew.hot_keys(df, by, hot_rows) is None:
        window = Window.partitionBy(*[q(c) for c in by]).orderBy(*[q(c) for c in order])
        return df.withColumns(build(window, lambda k: F.lit(True)))
    chunk_rows = max(chunk_rows, reach)
    indexed = global_index(df, [*by, *order])
    chunk = F.floor(F.col("__idx") / chunk_rows)
    position = F.pmod(F.col("__idx"), F.lit(chunk_rows))
    homes = F.when(position >= chunk_rows - reach, F.array(chunk, chunk + 1)).otherwise(
        F.array(chunk)
    )
    chunked = indexed.withColumn("__chunk", F.explode(homes))
    window = Window.partitionBy("__chunk").orderBy("__idx")

    def same(k: int) -> Column:
        keys = [F.lag(q(c), k).over(window).eqNullSafe(q(c)) for c in by]
        return reduce(lambda a, b: a & b, keys, F.lag("__idx", k).over(window).isNotNull())

    built = chunked.withColumns(build(window, same))
    return built.filter(F.col("__chunk") == chunk).drop("__chunk", "__idx")


def _lag_columns(target: str, steps: tuple[int, ...]) -> History:
    return lambda window, same: {
        f"{target}_lag_{k}": F.when(same(k), F.lag(q(target), k).over(window)) for k in steps
    }


def _rolling_columns(target: str, widths: tuple[int, ...]) -> History:
    def build(window: WindowSpec, same: Callable[[int], Column]) -> dict[str, Column]:
        new = {}
        for w in widths:
            past = window.rowsBetween(-w, -1)
            full = same(w) & (F.count(q(target)).over(past) == w)
            new[f"{target}_mean_{w}"] = F.when(full, F.avg(q(target)).over(past))
            new[f"{target}_std_{w}"] = F.when(full, F.stddev_samp(q(target)).over(past))
        return new

    return build


def lags(
    df: DataFrame,
    target: str,
    time: str,
    steps: tuple[int, ...] = LAGS,
    by: list[str] | None = None,
    tiebreak: list[str] | None = None,
    fmt: str | None = None,
    **options,
) -> DataFrame:
    """The target 1, 2, 3 and 7 rows earlier."""
    df = time_order(df, time, fmt)
    order = [time, *(tiebreak or [])]
    return with_history(df, order, by or [], max(steps), _lag_columns(target, tuple(steps)), **options)


def rolling(
    df: DataFrame,
    target: str,
    time: str,
    widths: tuple[int, ...] = WINDOWS,
    by: list[str] | None = None,
    tiebreak: list[str] | None = None,
    fmt: str | None = None,
    **options,
) -> DataFrame:
    """Mean and sample deviation of the 3 and 7 rows before the current one."""
    df = time_order(df, time, fmt)
    order = [time, *(tiebreak or [])]
    return with_history(
        df, order, by or [], max(widths), _rolling_columns(target, tuple(widths)), **options
    )


def calendar(df: DataFrame, time: str, fmt: str | None = None) -> DataFrame:
    """Year, month, day and day of week (Monday = 0)."""
    return df.withColumns(calendar_columns(as_time(df, time, fmt)))


def ts_features(
    df: DataFrame,
    target: str,
    time: str,
    steps: tuple[int, ...] = LAGS,
    widths: tuple[int, ...] = WINDOWS,
    by: list[str] | None = None,
    tiebreak: list[str] | None = None,
    keep_time: bool = False,
    fmt: str | None = None,
    **options,
) -> DataFrame:
    """Lags, rolling statistics and calendar parts; rows without full history go.

    The raw time goes too unless `keep_time`, which a chronological split needs.
    """
    df = time_order(df, time, fmt)
    lag, roll = _lag_columns(target, tuple(steps)), _rolling_columns(target, tuple(widths))

    def build(window: WindowSpec, same: Callable[[int], Column]) -> dict[str, Column]:
        return {**lag(window, same), **roll(window, same)}

    order = [time, *(tiebreak or [])]
    reach = max(*steps, *widths)
    built = with_history(df, order, by or [], reach, build, **options)
    new = [c for c in built.columns if c not in df.columns]
    full = calendar(built.dropna(subset=new), time)
    return full if keep_time else full.drop(time)
