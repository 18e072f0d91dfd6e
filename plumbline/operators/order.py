"""Exact global order and exact order statistics without a single-task sort."""

from __future__ import annotations

import sys
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.durable import materialize

BINS = 4096
LARGEST = sys.float_info.max


def global_index(df: DataFrame, order: list[str], index: str = "__idx") -> DataFrame:
    """Number all rows 0, 1, 2, … in the given order.

    The rows are range-partitioned, so sorted pieces lie side by side, and written
    once; each piece then adds the number of rows in the pieces before it. Copies
    with equal order columns are split by their input partition.
    """
    spark = df.sparkSession
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(f"`{c}`") for c in order], F.col("__origin")]
    ranged = (
        df.withColumn("__origin", F.spark_partition_id())
        .repartitionByRange(pieces, *by)
        .sortWithinPartitions(*by)
        .withColumn("__at", F.monotonically_increasing_id())
    )
    # monotonically_increasing_id is (partition << 33) + position
    placed = ranged.withColumns(
        {
            "__piece": F.shiftright("__at", 33).cast("int"),
            "__at": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    ).drop("__origin")
    stored = materialize(placed)
    sizes = stored.groupBy("__piece").count().orderBy("__piece").collect()  # one row per piece
    starts = accumulate((r["count"] for r in sizes), initial=0)
    rows = [(r["__piece"], start) for r, start in zip(sizes, starts)]
    offsets = spark.createDataFrame(rows, "__piece int, __start bigint")
    return (
        stored.join(F.broadcast(offsets), "__piece")
        .withColumn(index, F.col("__start") + F.col("__at"))
        .drop("__piece", "__start", "__at")
    )


def nth_value(df: DataFrame, col: str, n: int) -> int | float | None:
    """The n-th smallest (0-based) value of a numeric column, exactly."""
    return nth_values(df, {col: [n]})[col, n]


def medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """The exact median of each column; None without a known value."""
    known = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    counts = known.agg(*[F.count(F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`"))).alias(c) for c in cols]).first()
    wanted = {c: [(counts[c] - 1) // 2, counts[c] // 2] for c in cols if counts[c]}
    found = nth_values(known, wanted)
    return {c: sum(found[c, n] for n in wanted[c]) / 2 if c in wanted else None for c in cols}


def nth_values(df: DataFrame, wanted: dict[str, list[int]]) -> dict[tuple[str, int], int | float | None]:
    """The n-th smallest (0-based) value for each column and n, exactly, NaN left out.

    Each pass counts the rows in at most BINS equal bins of the remaining range of every
    wanted value, all in one job, then keeps the one bin that holds it; no pass shuffles
    more than its bins.
    """
    cols = list(wanted)
    if not cols:
        return {}

    def value(c: str) -> Column:
        v = F.col(f"`{c}`")
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(v), F.greatest(F.least(v, F.lit(LARGEST)), F.lit(-LARGEST)))
        return v

    values = df.select(*[value(c).alias(f"v{i}") for i, c in enumerate(cols)])
    aggs = [f(f"v{i}") for i in range(len(cols)) for f in (F.count, F.min, F.max)]
    limits = values.agg(*aggs).first()
    found: dict[tuple[str, int], int | float | None] = {}
    open_ranges: dict[tuple[str, int], list] = {}  # column, n -> n within the range, its ends
    for i, c in enumerate(cols):
        total, low, high = limits[3 * i : 3 * i + 3]
        for n in wanted[c]:
            if 0 <= n < total and low < high:
                open_ranges[c, n] = [n, low, high]
            else:
                found[c, n] = low if 0 <= n < total else None
    while open_ranges:
        keys = list(open_ranges)
        entries = []
        for k, (c, n) in enumerate(keys):
            _, low, high = open_ranges[c, n]
            v = F.col(f"v{cols.index(c)}")
            bin_of = F.when(v.between(low, high), _bin(v, low, high)).cast("bigint")
            whole = v if isinstance(low, int) else F.lit(None)
            parts = {"k": F.lit(k), "bin": bin_of, "d": v.cast("double"), "w": whole.cast("bigint")}
            entries.append(F.struct(*[e.alias(name) for name, e in parts.items()]))
        binned = values.select(F.inline(F.array(*entries))).filter(F.col("bin").isNotNull())
        ends = [F.min("d"), F.max("d"), F.min("w"), F.max("w")]
        rows = binned.groupBy("k", "bin").agg(F.count(F.lit(1)), *ends).orderBy("k", "bin").collect()  # BINS each
        for k, key in enumerate(keys):
            n, _, _ = open_ranges[key]
            for _, _, size, low, high, whole_low, whole_high in (r for r in rows if r["k"] == k):
                if n < size:
                    break
                n -= size
            if whole_low is not None:
                low, high = whole_low, whole_high
            if low < high:
                open_ranges[key] = [n, low, high]
            else:
                found[key] = low
                del open_ranges[key]
    return found


def _bin(v: Column, low: int | float, high: int | float) -> Column:
    """Number of the equal bin of `v` between the ends."""
    width = float(high) / 2 - float(low) / 2
    if width <= 0:  # neighbouring whole numbers that DOUBLE cannot tell apart
        return v - F.lit(low)
    share = (v.cast("double") / 2 - float(low) / 2) / width
    return F.least(F.floor(share * BINS), F.lit(BINS - 1))
