"""Finding and masking columns with personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.masking import (
    KIND_LABELS,
    VALUE_PATTERNS,
    mask_text,
    mask_value,
    matches_kind,
    name_kind,
)
from plumbline.operators.profile import first_values, missing, q

SAMPLE_SIZE = 50
MATCH_RATIO = 0.5


FOUND = "ordinal int, name string, kind string"


def pii_by_name(df: DataFrame) -> DataFrame:
    """Kind suggested by each column's name: rows (ordinal, name, kind)."""
    rows = [(i, c, name_kind(c)) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, FOUND)


def _readable(df: DataFrame) -> list[str]:
    opaque = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)
    return [f.name for f in df.schema if not isinstance(f.dataType, opaque)]


def pii_by_value(
    df: DataFrame,
    order_by: list[str] | None = None,
    sample: int | None = SAMPLE_SIZE,
    ratio: float = MATCH_RATIO,
    columns: list[str] | None = None,
) -> DataFrame:
    """Kind suggested by each column's values: rows (ordinal, name, kind).

    Looks at the first `sample` known values by `order_by`, or with sample=None at all
    values in one pass; NaN counts as missing. A kind holds when at least `ratio` of
    them match. One pass serves all columns known at the start, one more all others.
    """
    columns = _readable(df) if columns is None else columns
    if sample is not None and not order_by:
        raise ValueError("a sample needs order_by to be repeatable")
    ordinal = {c: i for i, c in enumerate(df.columns)}
    kinds = {}
    if columns and sample is None:
        shares = _all_shares(df, columns)
        kinds = {c: _first_kind(shares[c], ratio) for c in columns}
    elif columns:
        seen = first_values(df, {c: ~missing(df, c) for c in columns}, order_by, sample, _matches)
        for c in columns:
            shares = {k: sum(m[k] for m in seen[c]) / len(seen[c]) for k in VALUE_PATTERNS if seen[c]}
            kinds[c] = _first_kind(shares, ratio)
    found = [(ordinal[c], c, kinds[c]) for c in columns]
    return df.sparkSession.createDataFrame(found, FOUND)


def _matches(value: Column) -> Column:
    """Which kinds a value matches."""
    return F.struct(*[matches_kind(value, k).cast("int").alias(k) for k in VALUE_PATTERNS])


def _all_shares(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Share of all known values that match each kind, per column, in one pass."""
    matching = [
        F.avg(F.when(~missing(df, c), matches_kind(q(c).cast("string"), kind).cast("double"))).alias(f"{c}|{kind}")
        for c in columns
        for kind in VALUE_PATTERNS
    ]
    row = df.agg(*matching).first()
    return {c: {k: row[f"{c}|{k}"] for k in VALUE_PATTERNS} for c in columns}


def _first_kind(shares: dict, ratio: float) -> str | None:
    return next((k for k in VALUE_PATTERNS if (shares.get(k) or 0) >= ratio), None)


def detect_pii(
    df: DataFrame,
    order_by: list[str] | None = None,
    sample: int | None = SAMPLE_SIZE,
    ratio: float = MATCH_RATIO,
) -> DataFrame:
    """Columns with personal data: by name first, then by values."""
    rest = [c for c in _readable(df) if name_kind(c) is None]
    found = pii_by_value(df, order_by, sample, ratio, rest)
    return pii_by_name(df).unionByName(found).filter("kind IS NOT NULL")


def pii_report(detected: DataFrame) -> DataFrame:
    """Detected columns with the Korean label of their kind."""
    labels = F.create_map(*[F.lit(x) for pair in KIND_LABELS.items() for x in pair])
    return detected.withColumn("label", labels[F.col("kind")])


def mask_table(df: DataFrame, detected: DataFrame) -> DataFrame:
    """Mask every detected column."""
    kinds = {r["name"]: r["kind"] for r in detected.collect()}  # at most one row per column
    return df.withColumns({c: mask_value(q(c), kind) for c, kind in kinds.items()})


def mask_distribution(dist: DataFrame, label: str = "label", n: str = "n") -> DataFrame:
    """Mask class labels; labels that become equal add up."""
    masked = dist.groupBy(mask_text(q(label)).alias(label))
    return masked.agg(F.sum(q(n)).cast("bigint").alias(n))
