import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import prepare as prep
from plumbline.operators import profile as prof
from plumbline.operators.order import global_index, medians, nth_value


def test_logical_types(spark):
    df = spark.range(40).select(
        F.col("id").alias("n"),
        (F.col("id") > 3).alias("b"),
        F.current_date().alias("d"),
        F.when(F.col("id") > 0, F.concat(F.lit("c"), F.col("id") % 19)).alias("few"),
        F.concat(F.lit("c"), F.col("id") % 20).alias("many"),
        F.array("id").alias("a"),
    )
    kinds = {r["name"]: (r["data_type"], r["n_unique"]) for r in prof.infer_schema(df).collect()}
    assert kinds == {
        "n": ("NUMERIC", None), "b": ("BOOLEAN", None), "d": ("DATETIME", None),
        "few": ("CATEGORICAL", 19), "many": ("TEXT", None), "a": ("UNSUPPORTED", None),
    }


def test_samples_skip_missing_values(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "x", None), (3, "y", "b"), (4, "z", "c"), (5, "w", "d")], "i int, s string, t string")
    got = {}
    for r in prof.column_samples(df, ["i"]).collect():
        got.setdefault(r["name"], {})[r["position"]] = r["value"]
    assert got["s"] == {0: "x", 1: "y", 2: "z"}
    assert got["t"] == {0: "a", 1: "b", 2: "c"}
    assert got["i"] == {0: "1", 1: "2", 2: "3"}


def test_correlations_equal_pandas_with_gaps_and_constants(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    frame = pd.DataFrame({"x": x, "y": 2 * x + 1e6, "z": x + rng.normal(size=200), "c": 7.0, "g": x**3})
    frame.loc[::5, "g"] = np.nan
    df = spark.createDataFrame(frame).withColumn("g", F.when(~F.isnan("g"), F.col("g")))
    want = frame.corr()
    got = {(r["a"], r["b"]): r["corr"] for r in prof.correlations(df, list("xyzcg")).collect()}
    for (a, b), corr in got.items():
        expected = want.loc[a, b]
        assert corr is None if math.isnan(expected) else abs(corr - expected) < 1e-9
    high = prof.high_corr_pairs(df).collect()
    assert (high[0]["a"], high[0]["b"]) == ("x", "y")
    assert all(abs(r["corr"]) > 0.9 for r in high)


def test_many_columns_use_one_matrix(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame(rng.normal(size=(60, 32)), columns=[f"c{i}" for i in range(32)])
    frame["c31"] = -frame["c0"]
    pairs = prof.high_corr_pairs(spark.createDataFrame(frame)).collect()
    assert [(r["a"], r["b"], round(r["corr"], 9)) for r in pairs] == [("c0", "c31", -1.0)]


@pytest.mark.parametrize("columns", [2, 31, 60])
def test_correlations_with_gaps_at_any_width(spark, columns):
    """With 60 columns no row is complete; NaN and NULL both count as missing."""
    rng = np.random.default_rng(columns)
    frame = pd.DataFrame(rng.normal(size=(400, columns)), columns=[f"c{i}" for i in range(columns)])
    frame["c1"] = frame["c0"] + 0.3 * frame["c1"]
    frame = frame.mask(rng.random(frame.shape) < 0.1)
    got = {(r["a"], r["b"]): r["corr"] for r in prof.correlations(spark.createDataFrame(frame), list(frame)).collect()}
    want = frame.corr()
    assert len(got) == columns * (columns - 1) // 2
    assert all(abs(c - want.loc[a, b]) < 1e-9 for (a, b), c in got.items())
    half = spark.createDataFrame(frame).withColumn("c0", F.when(~F.isnan("c0"), F.col("c0")))
    again = prof.correlations(half, ["c0", "c1"]).first()["corr"]
    assert abs(again - got["c0", "c1"]) < 1e-12


def test_samples_of_many_short_columns_need_no_more_jobs_than_of_one(spark):
    rows = [(i, *(str(i) if i > 40 + k else None for k in range(6))) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"s{k} string" for k in range(6))).repartition(4)

    def run(cols, group):
        spark.sparkContext.setJobGroup(group, group)
        found = prof.first_values(df, {c: F.col(c).isNotNull() for c in cols}, ["i"], 3)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    found, many = run(df.columns, "many")
    assert found == {"i": ["0", "1", "2"], **{f"s{k}": [str(41 + k + j) for j in range(3)] for k in range(6)}}
    assert many <= run(["i", "s0"], "one")[1]


def test_medians_of_all_columns_together(spark):
    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"a": rng.normal(size=501), "b": rng.integers(-5, 5, 501).astype(float), "c": np.nan, "d": 1e300 * rng.normal(size=501)})
    frame.loc[::7, "a"] = np.nan
    got = medians(spark.createDataFrame(frame).repartition(5), list("abcd"))
    assert got["c"] is None and all(got[k] == frame[k].median() for k in "abd")


def test_only_plain_numbers_are_coerced(spark):
    texts = ["12", " 1.5 ", "-3e2", ".5", "12D", "7f", "0x1p3", "1_000", "abc", "", None, "inf"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["t"] for r in prep.coerce_numeric(df, ["t"]).collect()]
    assert got == [12.0, 1.5, -300.0, 0.5, None, None, None, None, None, None, None, math.inf]


def test_target_is_no_feature(spark):
    df = spark.createDataFrame([(float(i), float(2 * i), float(i * i)) for i in range(5)], "a double, b double, t double")
    assert [(r["a"], r["b"]) for r in prof.high_corr_pairs(df, "t").collect()] == [("a", "b")]


def test_null_counts_count_nan(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), "a"), (None, "b")], "d double, s string")
    assert {r["name"]: r["n_null"] for r in prof.null_counts(df).collect()} == {"d": 2, "s": 1}


def test_profile_sections(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a", 9), (2.0, 4.1, "b", 9), (3.0, 6.0, "a", 9)], "x double, y double, t string, __meta int")
    rows = {(r["section"], r["name"], r["stat"]): r["value"] for r in prof.profile(df, "t").collect()}
    assert rows["shape", "table", "columns"] == 3
    assert rows["class_distribution", "a", "rows"] == 2
    assert rows["numeric_stats", "x", "std"] == 1.0
    assert rows["high_correlation_pairs", "x", "y"] > 0.99
    stats = {r["section"] for r in prof.profile(df, "y", "regression").collect() if r["name"] == "y"}
    assert stats == {"null_counts", "target_stats"}


@pytest.mark.parametrize("n, kept", [(50, True), (51, False)])
def test_encoding_limit(spark, n, kept):
    df = spark.range(n * 2).select(F.format_string("v%03d", F.col("id") % n).alias("s"), F.lit("x").alias("t"))
    got = prep.encode_labels(df, target="t")
    assert ("s" in got.columns) == kept
    if kept:
        assert {r["s"] for r in got.select("s").collect()} == set(range(n))
    assert got.first()["t"] == "x"


def test_prepare_gives_a_complete_numeric_table(spark):
    df = spark.createDataFrame(
        [("b", 1.0, True, 1, "y"), ("a", float("nan"), False, 2, "n"), ("c", 3.0, None, 3, "y"), ("a", 4.0, True, 4, "n")],
        "s string, d double, b boolean, __id int, t string",
    )
    got = prep.prepare(df, "t")
    assert sorted(map(tuple, got.collect())) == [(0, 4.0, 1, "n"), (1, 1.0, 1, "y")]


def test_coercion_scaling_and_filling(spark):
    df = spark.createDataFrame([("1",), (" 2.5 ",), ("x",), (None,)], "v string")
    coerced = prep.coerce_numeric(df, ["v"])
    assert [r["v"] for r in coerced.collect()] == [1.0, 2.5, None, None]
    assert [r["v"] for r in prep.impute(coerced, ["v"], "mean").collect()] == [1.0, 2.5, 1.75, 1.75]
    odd = spark.createDataFrame([(5.0,), (1.0,), (9.0,), (None,)], "v double")
    assert [r["v"] for r in prep.impute(odd, ["v"], "median").collect()] == [5.0, 1.0, 9.0, 5.0]
    flat = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [r["v"] for r in prep.scale(flat, ["v"]).collect()] == [0.0, 0.0]


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_class_weights(spark, hot_rows):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "t string")
    weights = {r["t"]: r["weight"] for r in prep.class_weights(df, "t", hot_rows=hot_rows).collect()}
    assert weights == {"a": 8 / (2 * 6), "b": 8 / (2 * 2)}


def test_drop_collinear_keeps_the_earlier_column(spark):
    df = spark.createDataFrame([(1, 2, 3)], "b int, a int, c int")
    pairs = spark.createDataFrame([("a", "b", 0.99)], "a string, b string, corr double")
    assert prep.drop_collinear(df, pairs).columns == ["b", "c"]


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_order_statistic_is_exact(spark, kind, monkeypatch):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.integers(-(2**62), 2**62, 300), np.repeat(5, 200), [2**62, 2**62 + 1, -(2**62)]])
    df = spark.createDataFrame([(int(v),) for v in values], "v bigint").withColumn("v", F.col("v").cast(kind))
    want = sorted(r["v"] for r in df.collect())
    for n in (0, 1, 150, 250, 400, len(want) - 2, len(want) - 1):
        assert nth_value(df, "v", n) == want[n]
    assert nth_value(df, "v", len(want)) is None


@pytest.mark.parametrize("parts", [1, 7])
def test_global_index_is_exact_and_splits_copies(spark, parts):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), F.lit(1).alias("b")).repartition(parts)
    rows = global_index(df, ["a"]).orderBy("__idx").collect()
    assert [r["__idx"] for r in rows] == list(range(1000))
    assert [r["a"] for r in rows] == sorted(r["a"] for r in rows)
