"""Column profiles, each computed in one pass over the table."""

from __future__ import annotations

import math
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.durable import materialize

INTERNAL_PREFIX = "__"
CATEGORY_LIMIT = 20
CORR_THRESHOLD = 0.9
CORR_PAIRS = 10
PAIR_SCHEMA = "a string, b string, corr double"
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
METHOD_BYTES = 8000  # longer methods stay interpreted


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def drop_internal(df: DataFrame) -> DataFrame:
    """Hide metadata columns, whose names start with two underscores."""
    return df.drop(*[c for c in df.columns if c.startswith(INTERNAL_PREFIX)])


def few_distinct(df: DataFrame, cols: list[str], limit: int) -> dict[str, list]:
    """Sorted distinct non-NULL values of the columns that have at most `limit` of them.

    A sketch first rules out columns far beyond the limit, so the exact sets of the
    second pass stay small.
    """
    if not cols:
        return {}
    sketched = df.agg(*[F.approx_count_distinct(q(c), 0.02).alias(c) for c in cols]).first()
    near = [c for c in cols if sketched[c] <= 2 * limit + 10]
    if not near:
        return {}
    sets = df.agg(*[F.array_sort(F.collect_set(q(c))).alias(c) for c in near]).first()
    return {c: sets[c] for c in near if len(sets[c]) <= limit}


def infer_schema(df: DataFrame) -> DataFrame:
    """Logical type per column; strings with fewer than 20 values are CATEGORICAL.

    `n_unique` is given for CATEGORICAL columns only.
    """
    few = few_distinct(df, string_columns(df), CATEGORY_LIMIT - 1)

    def kind(f: T.StructField) -> str:
        if isinstance(f.dataType, T.BooleanType):
            return "BOOLEAN"
        if isinstance(f.dataType, T.NumericType):
            return "NUMERIC"
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return "DATETIME"
        if isinstance(f.dataType, T.StringType):
            return "CATEGORICAL" if f.name in few else "TEXT"
        return "UNSUPPORTED"

    rows = [
        (i, f.name, kind(f), len(few[f.name]) if f.name in few else None)
        for i, f in enumerate(df.schema)
    ]
    return df.sparkSession.createDataFrame(
        rows, "ordinal int, name string, data_type string, n_unique bigint"
    )


def first_rows(df: DataFrame, order_by: list[str], n: int) -> DataFrame:
    """The `n` first rows in the given order.

    The leading order column alone is read first, to find how far the rows reach; the
    filter on it then keeps the scan of all columns to the files that hold them.
    """
    lead = q(order_by[0])
    reach = df.select(lead.alias("k")).orderBy("k").limit(n).agg(F.max("k")).first()[0]
    near = lead.isNull() if reach is None else lead.isNull() | (lead <= F.lit(reach))
    return df.filter(near).orderBy(*[q(c) for c in order_by]).limit(n)


def column_samples(df: DataFrame, order_by: list[str], n: int = 3) -> DataFrame:
    """The first `n` non-NULL values of each column, one row per value.

    One look at the first rows serves all columns without a NULL there; one more job
    serves all others.
    """
    found = first_values(df, {c: q(c).isNotNull() for c in df.columns}, order_by, n)
    rows = [(i, c, k, v) for i, c in enumerate(df.columns) for k, v in enumerate(found[c])]
    return df.sparkSession.createDataFrame(
        rows, "ordinal int, name string, position int, value string"
    )


def first_values(
    df: DataFrame, known: dict[str, Column], order_by: list[str], n: int, show: Callable[[Column], Column] | None = None
) -> dict[str, list]:
    """The first `n` known values of each column, in the given order of rows.

    `known` tells per column which values count, `show` what to return of a value's text. Columns that are known throughout the
    first rows are done with these; the others are read together, and each task keeps
    its first `n` values per column before anything is shuffled.
    """
    cols = list(known)
    shown = {c: show(q(c).cast("string")) if show else q(c).cast("string") for c in cols}
    head = first_rows(df, order_by, n).select(
        *[F.struct(known[c].alias("ok"), shown[c].alias("v")).alias(f"c{i}") for i, c in enumerate(cols)]
    ).collect()  # n rows
    found = {c: [r[i]["v"] for r in head] for i, c in enumerate(cols)}
    short = [c for i, c in enumerate(cols) if not all(r[i]["ok"] for r in head)]
    if short:
        entries = [
            F.when(known[c], F.struct(F.lit(i).alias("i"), shown[c].alias("v"))) for i, c in enumerate(short)
        ]
        places = [f"o{i}" for i in range(len(order_by))]
        entry = F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")
        values = df.select(*[q(c).alias(o) for c, o in zip(order_by, places)], entry).select("*", "e.*")
        first = F.row_number().over(Window.partitionBy("i").orderBy(*places))
        rows = values.withColumn("r", first).filter(F.col("r") <= n).orderBy("i", "r").collect()  # n per column
        for i, c in enumerate(short):
            found[c] = [r["v"] for r in rows if r["i"] == i]
    return found


def shape(df: DataFrame, name: str = "table") -> DataFrame:
    """Row and column counts."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
    )


def missing(df: DataFrame, c: str) -> Column:
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return q(c).isNull() | F.isnan(q(c))
    return q(c).isNull()


def _melt(row: DataFrame, parts: dict[str, dict[str, Column]]) -> DataFrame:
    """One output row per entry of `parts` from a one-row table."""
    entries = [
        F.struct(F.lit(name).alias("name"), *[c.alias(k) for k, c in cols.items()])
        for name, cols in parts.items()
    ]
    return row.select(F.inline(F.array(*entries)))


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values per column."""
    row = df.agg(*[F.count_if(missing(df, c)).alias(c) for c in df.columns])
    return _melt(row, {c: {"n_null": q(c)} for c in df.columns})


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Rows per label; missing labels are left out."""
    labels = df.filter(q(target).isNotNull()).groupBy(q(target).cast("string").alias("label"))
    return labels.agg(F.count(F.lit(1)).alias("n"))


STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def numeric_stats(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Mean, sample standard deviation, minimum and maximum per numeric column."""
    cols = cols or numeric_columns(df)
    row = df.agg(
        *[f(q(c).cast("double")).alias(f"{c}|{s}") for c in cols for s, f in STATS.items()]
    )
    return _melt(row, {c: {s: q(f"{c}|{s}") for s in STATS} for c in cols})


def target_stats(df: DataFrame, target: str) -> DataFrame:
    return numeric_stats(df, [target])


def pearson(a: Column, b: Column) -> Column:
    """Correlation over rows where both are known; NULL when one is constant."""
    x, y = F.when(b.isNotNull(), a.cast("double")), F.when(a.isNotNull(), b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _pair_sums(batches, shifts: list[float]):
    """Per task and pair of columns: n, sums and sums of products of rows where both are known."""
    p = len(shifts)
    total = np.zeros((5, p, p))
    for batch in batches:
        x = np.stack([batch[i].to_numpy(zero_copy_only=False).astype(float) for i in range(p)], axis=1)
        known = ~np.isnan(x)
        x = np.where(known, x - np.array(shifts), 0.0)
        m = known.astype(float)
        total += [m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, x.T @ x]
    # x and y are the row's and the column's value; the square of y is that of x, mirrored
    i, j = np.triu_indices(p, 1)
    n, sx, sy, sxx, sxy = (t[i, j] for t in total)
    columns = {"i": i, "j": j, "n": n, "sx": sx, "sy": sy, "sxx": sxx, "syy": total[3][j, i], "sxy": sxy}
    yield pa.record_batch({k: pa.array(v, pa.int32() if k in "ij" else pa.float64()) for k, v in columns.items()})


@contextmanager
def small_methods(spark: SparkSession):
    """Let Spark cut the code of wide projections into methods that the JVM compiles."""
    before = spark.conf.get(METHOD_LIMIT)
    spark.conf.set(METHOD_LIMIT, METHOD_BYTES)
    try:
        yield
    finally:
        spark.conf.set(METHOD_LIMIT, before)


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns as rows (a, b, corr).

    Each pair uses the rows where both are known, NaN counting as missing, whatever the
    number of columns; NULL when a column is constant there. A first pass finds the
    means; the second multiplies whole batches of columns and sums per pair.
    """
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    numbers = df.select(*[F.nanvl(q(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])
    with small_methods(df.sparkSession):
        return _correlations(numbers, cols)


def _correlations(numbers: DataFrame, cols: list[str]) -> DataFrame:
    means = numbers.agg(*[F.avg(f"c{i}") for i in range(len(cols))]).first()
    shifts = [0.0 if m is None or not math.isfinite(m) else m for m in means]  # sums around the means lose no digits
    kinds = "i int, j int, " + ", ".join(f"{c} double" for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    parts = numbers.mapInArrow(lambda batches: _pair_sums(batches, shifts), kinds)
    # written here, a row per pair: the setting above holds for what runs now
    sums = materialize(parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]))
    n = F.col("n")
    x, y = (F.col(f"s{c}{c}") - F.col(f"s{c}") * F.col(f"s{c}") / n for c in "xy")
    both = F.col("sxy") - F.col("sx") * F.col("sy") / n
    # what is left of a constant by rounding is no spread
    tiny = 1e-12
    spread = F.when((x > tiny * F.col("sxx")) & (y > tiny * F.col("syy")), F.sqrt(x) * F.sqrt(y))
    corr = F.when(spread.isNotNull() & (n > 1), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), both / spread)))
    names = F.array(*[F.lit(c) for c in cols])
    return sums.select(F.get(names, "i").alias("a"), F.get(names, "j").alias("b"), corr.alias("corr"))


def high_corr_pairs(
    df: DataFrame,
    target: str | None = None,
    threshold: float = CORR_THRESHOLD,
    limit: int = CORR_PAIRS,
) -> DataFrame:
    """The feature pairs with the highest |correlation| above the threshold."""
    cols = [c for c in numeric_columns(df) if c != target]
    strong = correlations(df, cols).filter(F.abs("corr") > threshold)
    return strong.orderBy(F.abs("corr").desc(), "a", "b").limit(limit)


def annotate_schema(profile: DataFrame, spec: DataFrame) -> DataFrame:
    """Add a data dictionary (name, description, is_target) to an inferred schema.

    Dictionary rows for unknown columns are dropped; only the first target counts.
    """
    joined = profile.join(spec, "name", "left")
    first = joined.filter("is_target").agg(F.min("ordinal")).first()[0]
    return joined.select(
        *profile.columns,
        F.coalesce(F.trim("description"), F.lit("")).alias("description"),
        (F.col("ordinal") == F.lit(-1 if first is None else first)).alias("is_target"),
    )


def profile(df: DataFrame, target: str | None = None, task: str = "classification") -> DataFrame:
    """Shape, missing values, statistics, target and correlations as rows.

    Rows are (section, name, stat, value). One pass yields sizes, missing values and
    statistics of all columns; correlations and class counts follow.
    """
    df = drop_internal(df)
    cols = numeric_columns(df)
    aggs, rows = [F.count(F.lit(1)).alias("rows")], []

    def entry(section: str, name: str, stat: str, value: Column) -> None:
        keys = {"section": section, "name": name, "stat": stat}
        rows.append(
            F.struct(*[F.lit(x).alias(k) for k, x in keys.items()], value.cast("double").alias("value"))
        )

    entry("shape", "table", "rows", q("rows"))
    entry("shape", "table", "columns", F.lit(len(df.columns)))
    for i, c in enumerate(df.columns):
        aggs.append(F.count_if(missing(df, c)).alias(f"null{i}"))
        entry("null_counts", c, "nulls", q(f"null{i}"))
    for i, c in enumerate(cols):
        section = "target_stats" if c == target and task != "classification" else "numeric_stats"
        for s, f in STATS.items():
            aggs.append(f(q(c).cast("double")).alias(f"{s}{i}"))
            entry(section, c, s, q(f"{s}{i}"))
    result = df.agg(*aggs).select(F.inline(F.array(*rows)))
    strong = high_corr_pairs(df, target).select(
        F.lit("high_correlation_pairs").alias("section"),
        F.col("a").alias("name"),
        F.col("b").alias("stat"),
        F.col("corr").alias("value"),
    )
    result = result.unionByName(strong)
    if target is not None and task == "classification":
        classes = class_distribution(df, target).select(
            F.lit("class_distribution").alias("section"),
            F.col("label").alias("name"),
            F.lit("rows").alias("stat"),
            F.col("n").cast("double").alias("value"),
        )
        result = result.unionByName(classes)
    return result
