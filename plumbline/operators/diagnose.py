"""Rule-based trust checks on run results.

A run row may hold n_train, n_test, accuracy, r2, class_distribution (map),
high_correlation_pairs (array of a, b, corr), feature_importance (map), preprocessing
(array of steps) and the mitigation flags smote and balanced; a step that names smote or
balanced counts like its flag. Missing columns count as NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Check names and verdicts as users know them.
SAMPLE_SIZE = "샘플 수"
ACCURACY_TOO_HIGH = "정확도 과도"
ACCURACY_TOO_LOW = "정확도 부족"
ACCURACY = "정확도"
IMBALANCE = "클래스 불균형"
R2_TOO_HIGH = "R² 과도"
R2_NEGATIVE = "R² 음수"
R2_TOO_LOW = "설명력 부족"
R2 = "설명력"
COLLINEARITY = "다중공선성"
CONCENTRATION = "피처 쏠림"
UNTRUSTED = "신뢰 어려움"
CAUTION = "주의 필요"
TRUSTED = "신뢰 가능"

CHECK_TYPE = "struct<level:string,item:string,value:double,detail:string>"
RUN_COLUMNS = {
    "n_train": "bigint",
    "n_test": "bigint",
    "accuracy": "double",
    "r2": "double",
    "class_distribution": "map<string,bigint>",
    "high_correlation_pairs": "array<struct<a:string,b:string,corr:double>>",
    "feature_importance": "map<string,double>",
    "smote": "boolean",
    "balanced": "boolean",
    "preprocessing": "array<string>",
}


def _check(level: str, item: str, value: Column, detail: Column | None = None) -> Column:
    text = F.lit(None) if detail is None else detail
    return F.struct(
        F.lit(level).alias("level"),
        F.lit(item).alias("item"),
        value.cast("double").alias("value"),
        text.cast("string").alias("detail"),
    )


def _sample_size() -> Column:
    n = F.coalesce("n_train", F.lit(0)) + F.coalesce("n_test", F.lit(0))
    return (
        F.when(n < 100, _check("critical", SAMPLE_SIZE, n))
        .when(n < 500, _check("warning", SAMPLE_SIZE, n))
        .otherwise(_check("ok", SAMPLE_SIZE, n))
    )


def _accuracy() -> Column:
    a = F.col("accuracy")
    return (
        F.when(a > 0.995, _check("critical", ACCURACY_TOO_HIGH, a))
        .when(a < 0.55, _check("critical", ACCURACY_TOO_LOW, a))
        .when(a < 0.70, _check("warning", ACCURACY, a))
        .when(a.isNotNull(), _check("ok", ACCURACY, a))
    )


def _imbalance() -> Column:
    counts = F.map_values("class_distribution")
    ratio = F.array_max(counts) / F.greatest(F.array_min(counts), F.lit(1))

    def applied(word: str) -> Column:
        named = F.exists("preprocessing", lambda step: F.contains(F.lower(step), F.lit(word)))
        return F.coalesce(word, F.lit(False)) | F.coalesce(named, F.lit(False))

    smote, balanced = applied("smote"), applied("balanced")
    severe = (
        F.when(smote, _check("ok", IMBALANCE, ratio))
        .when(balanced, _check("warning", IMBALANCE, ratio))
        .otherwise(_check("critical", IMBALANCE, ratio))
    )
    mild = F.when(smote | balanced, _check("ok", IMBALANCE, ratio)).otherwise(
        _check("warning", IMBALANCE, ratio)
    )
    return F.when(
        F.size("class_distribution") >= 2, F.when(ratio > 10, severe).when(ratio > 3, mild)
    )


def _r2() -> Column:
    r = F.col("r2")
    return (
        F.when(r > 0.995, _check("critical", R2_TOO_HIGH, r))
        .when(r < 0.0, _check("critical", R2_NEGATIVE, r))
        .when(r < 0.3, _check("critical", R2_TOO_LOW, r))
        .when(r < 0.6, _check("warning", R2, r))
        .when(r.isNotNull(), _check("ok", R2, r))
    )


def _collinearity() -> Column:
    pairs = F.col("high_correlation_pairs")
    named = F.transform(
        F.slice(pairs, 1, 3),
        lambda p: F.format_string("%s~%s(%.2f)", p["a"], p["b"], p["corr"]),
    )
    more = F.when(F.size(pairs) > 3, F.format_string(" 외 %d쌍", F.size(pairs) - 3)).otherwise("")
    detail = F.concat(F.array_join(named, ", "), more)
    return F.when(F.size(pairs) > 0, _check("warning", COLLINEARITY, F.size(pairs), detail))


def _concentration() -> Column:
    shares = F.map_values("feature_importance")
    total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    top = F.array_max(shares)
    ratio = F.when(total > 0, top / total).otherwise(0.0)
    entries = F.map_entries("feature_importance")
    name = F.filter(entries, lambda e: e["value"] == top)[0]["key"]
    return F.when(
        (F.size("feature_importance") >= 2) & (ratio > 0.85),
        _check("warning", CONCENTRATION, ratio, name),
    )


def verdict(checks: Column | str) -> Column:
    """Any critical check: untrusted; else any warning: caution; else trusted."""
    return (
        F.when(F.exists(checks, lambda c: c["level"] == "critical"), UNTRUSTED)
        .when(F.exists(checks, lambda c: c["level"] == "warning"), CAUTION)
        .otherwise(TRUSTED)
    )


def diagnose(runs: DataFrame) -> DataFrame:
    """Add the array `checks` and the `verdict` to every run."""
    absent = {
        c: F.lit(None).cast(kind) for c, kind in RUN_COLUMNS.items() if c not in runs.columns
    }
    rules = [_sample_size(), _accuracy(), _imbalance(), _r2(), _collinearity(), _concentration()]
    fired = F.filter(F.array(*[r.cast(CHECK_TYPE) for r in rules]), lambda c: c.isNotNull())
    return (
        runs.withColumns(absent)
        .withColumn("checks", fired)
        .withColumn("verdict", verdict("checks"))
        .drop(*absent)
    )


def check_rows(diagnosed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per check."""
    return diagnosed.select(*keys, F.inline("checks"))


def feedback(diagnosed: DataFrame, keys: list[str]) -> DataFrame:
    """The warnings and critical checks to improve on, one per row."""
    return check_rows(diagnosed, keys).filter(F.col("level").isin("warning", "critical"))
