"""Preparing features: coercion, encoding, filling, scaling, weighting."""

from __future__ import annotations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import skew
from plumbline.operators.order import medians
from plumbline.operators.profile import (
    drop_internal,
    few_distinct,
    numeric_columns,
    q,
    string_columns,
)

MAX_CATEGORIES = 50
# the cast alone would also take 12D, 7f and 0x1p3
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))$"


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns as DOUBLE; values that are no plain number become NULL."""

    def number(c: str) -> Column:
        if isinstance(df.schema[c].dataType, T.NumericType):
            return q(c).cast("double")
        text = F.trim(q(c).cast("string"))
        return F.when(text.rlike(NUMBER), text.try_cast("double"))

    return df.withColumns({c: number(c) for c in cols})


def encode_labels(
    df: DataFrame, target: str | None = None, max_categories: int = MAX_CATEGORIES
) -> DataFrame:
    """Number the values of each string column in sorted order, from 0.

    String columns with more values are dropped. The target is left as it is.
    """
    cols = [c for c in string_columns(df) if c != target]
    few = few_distinct(df, cols, max_categories)
    codes = {
        c: F.array_position(F.array(*[F.lit(v) for v in values]), q(c)) - 1
        if values
        else F.lit(None).cast("bigint")
        for c, values in few.items()
    }
    return df.withColumns(codes).drop(*[c for c in cols if c not in few])


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with any NULL or NaN."""
    return df.dropna("any")


def prepare(
    df: DataFrame, target: str, max_categories: int = MAX_CATEGORIES, numeric: tuple[str, ...] = ()
) -> DataFrame:
    """Complete numeric table for model fitting.

    Metadata columns go, the `numeric` text columns are coerced to numbers, times count
    as text, text with many values goes, the rest is encoded; finally rows with missing
    values are dropped.
    """
    df = coerce_numeric(drop_internal(df), list(numeric))
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    plain = (T.NumericType, T.StringType, T.BooleanType)
    as_text = {f.name: q(f.name).cast("string") for f in df.schema if isinstance(f.dataType, times)}
    as_int = {
        f.name: q(f.name).cast("int")
        for f in df.schema
        if isinstance(f.dataType, T.BooleanType) and f.name != target
    }
    other = [f.name for f in df.schema if not isinstance(f.dataType, (*times, *plain))]
    usable = df.drop(*other).withColumns({**as_text, **as_int})
    return drop_incomplete(encode_labels(usable, target, max_categories))


def scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """Centre to mean 0 and divide by the population standard deviation."""
    stats = df.agg(
        *[F.avg(q(c)).alias(f"m|{c}") for c in cols],
        *[F.stddev_pop(q(c)).alias(f"s|{c}") for c in cols],
    ).first()
    return df.withColumns(
        {
            c: (q(c) - F.lit(stats[f"m|{c}"]).cast("double")) / F.lit(stats[f"s|{c}"] or 1.0)
            for c in cols
        }
    )


def impute(df: DataFrame, cols: list[str], how: str = "mean") -> DataFrame:
    """Fill missing values with the column's mean or exact median."""
    if how == "mean":
        known = [F.avg(F.when(~F.isnan(q(c).cast("double")), q(c))).alias(c) for c in cols]
        fill = df.agg(*known).first().asDict()
    elif how == "median":
        fill = medians(df, cols)
    else:
        raise ValueError("how must be 'mean' or 'median'")
    return df.withColumns(
        {
            c: F.when(q(c).isNull() | F.isnan(q(c).cast("double")), F.lit(fill[c]))
            .otherwise(q(c))
            .cast("double")
            for c in cols
        }
    )


def derive(df: DataFrame, features: dict[str, str]) -> DataFrame:
    """Add features given as SQL expressions."""
    return df.withColumns({name: F.expr(sql) for name, sql in features.items()})


def class_weights(
    df: DataFrame, target: str, weight: str = "weight", hot_rows: int | None = None
) -> DataFrame:
    """Add the balanced weight n / (classes * rows of the class) to every row."""
    counts = df.groupBy(q(target)).agg(F.count(F.lit(1)).alias("__n"))
    n, k = counts.filter(q(target).isNotNull()).agg(F.sum("__n"), F.count("__n")).first()
    share = F.lit(float(n or 0)) / (F.lit(k) * F.col("__n"))
    weights = counts.select(
        q(target), F.when(q(target).isNotNull(), share).alias(weight)
    )
    small = skew.broadcast_if_small(weights)
    if small is not weights:
        return skew.join_on(df, small, [target], "left")
    hot = skew.hot_keys(df, [target], hot_rows)
    return skew.lookup_join(df, weights, [target], "left", hot)


def drop_collinear(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Drop the later column of every highly correlated pair."""
    at = {c: i for i, c in enumerate(df.columns)}
    listed = pairs.select("a", "b").collect()  # at most the 10 pairs of the report
    return df.drop(*{max(r["a"], r["b"], key=at.__getitem__) for r in listed})


def collinear_components(df: DataFrame, pairs: DataFrame, share: float = 0.95) -> DataFrame:
    """Replace the columns of highly correlated pairs by principal components `pca_1`, ….

    The columns are scaled first; the fewest components that hold `share` of their
    variance are kept. Rows with a missing value there have NULL components. Only the
    covariance of the listed columns is collected.
    """
    listed = pairs.select("a", "b").collect()  # at most the 10 pairs of the report
    cols = [c for c in df.columns if any(c in (r["a"], r["b"]) for r in listed)]
    if not cols:
        return df
    scaled = scale(df.select(*[q(c).cast("double").alias(c) for c in cols]).dropna(), cols)
    vectors = VectorAssembler(inputCols=cols, outputCol="v").transform(scaled)
    model = PCA(k=len(cols), inputCol="v", outputCol="p").fit(vectors)
    held = model.explainedVariance.toArray().cumsum()
    k = min(len(cols), int((held < share).sum()) + 1)
    means = df.select(*[q(c).cast("double").alias(c) for c in cols]).dropna()
    stats = means.agg(*[f(q(c)) for c in cols for f in (F.avg, F.stddev_pop)]).first()
    parts = {c: (q(c).cast("double") - F.lit(stats[2 * i])) / F.lit(stats[2 * i + 1] or 1.0) for i, c in enumerate(cols)}
    weights = model.pc.toArray()
    new = {f"pca_{j + 1}": sum(parts[c] * float(weights[i, j]) for i, c in enumerate(cols)) for j in range(k)}
    return df.withColumns(new).drop(*cols)


def feature_columns(df: DataFrame, target: str, exclude: tuple[str, ...] = ()) -> list[str]:
    """Numeric feature columns of a prepared table."""
    return [c for c in numeric_columns(df) if c != target and c not in exclude]
