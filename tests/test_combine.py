import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import skew
from plumbline.operators.asof import DIRECTIONS, asof_chain, asof_join
from plumbline.operators.combine import combine, concat_tables, join_tables

BASE = pd.Timestamp("2024-01-01")


def side(spark, frame, *cols):
    return spark.createDataFrame(frame).withColumn("t", F.col("t").cast("timestamp_ntz"))


def frames(seed, n_left=60, n_right=30, span=40):
    rng = np.random.default_rng(seed)

    def make(n, name):
        t = BASE + pd.to_timedelta(rng.integers(0, span, n), unit="s")
        return pd.DataFrame({"t": t, name: np.arange(n), "g": rng.integers(0, 3, n)})

    left = make(n_left, "v").sort_values(["t", "v"]).reset_index(drop=True)
    right = make(n_right, "w").sort_values(["t", "w"]).reset_index(drop=True)
    return left, right


@pytest.mark.parametrize("direction, tolerance", list(itertools.product(DIRECTIONS, [None, 0, 1])))
def test_asof_equals_pandas(spark, direction, tolerance):
    left, right = frames(1)
    right = right.drop(columns="g")
    limit = pd.Timedelta(seconds=tolerance) if tolerance else None
    want = pd.merge_asof(left, right, on="t", direction=direction, tolerance=limit)
    want = want.sort_values("v")["w"].to_numpy()
    for bucket_rows, hot_rows in ((10**6, None), (7, 1)):
        got = asof_join(
            side(spark, left), side(spark, right), "t", "t", direction, tolerance,
            bucket_rows=bucket_rows, hot_rows=hot_rows,
        ).toPandas()
        assert list(got.columns) == ["t", "v", "g", "w"]
        assert np.array_equal(got.sort_values("v")["w"].to_numpy(dtype=float), want, equal_nan=True)


@pytest.mark.parametrize("direction", DIRECTIONS)
def test_asof_by_key_equals_pandas(spark, direction):
    left, right = frames(2, 90, 60)
    want = pd.merge_asof(left, right, on="t", by="g", direction=direction).sort_values("v")["w"]
    for bucket_rows in (10**6, 11):
        got = asof_join(
            side(spark, left).repartition(5), side(spark, right), "t", "t", direction, by=["g"],
            bucket_rows=bucket_rows,
        ).toPandas()
        assert np.array_equal(
            got.sort_values("v")["w"].to_numpy(dtype=float), want.to_numpy(), equal_nan=True
        )


def test_one_instant_holding_most_rows(spark):
    left = spark.range(5000).select(F.lit("2024-01-01 00:00:05").alias("t"), F.col("id").alias("v"))
    right = spark.range(3000).select(F.lit("2024-01-01 00:00:01").alias("t"), F.col("id").alias("w"))
    for hot_rows in (None, 100):
        got = asof_join(left, right, "t", "t", "backward", hot_rows=hot_rows)
        assert got.count() == 5000
        assert got.agg(F.min("w"), F.max("w")).first() == (2999, 2999)


def test_unparseable_times_go_and_empty_sides_fail(spark):
    good = spark.createDataFrame([("2024-01-01", 1), ("soon", 2), (None, 3)], "t string, v int")
    bad = spark.createDataFrame([("never", 1)], "t string, w int")
    assert asof_join(good, good.withColumnRenamed("v", "w"), "t", "t").count() == 1
    with pytest.raises(ValueError, match="right"):
        asof_join(good, bad, "t", "t")
    with pytest.raises(ValueError, match="left"):
        asof_join(bad, good, "t", "t")
    with pytest.raises(ValueError, match="no column"):
        asof_join(good, good, "t", "when")


def test_clashing_names_and_both_time_columns(spark):
    left = spark.createDataFrame([("2024-01-01", 1)], "a string, v int")
    right = spark.createDataFrame([("2024-01-01", 2)], "b string, v int")
    got = asof_join(left, right, "a", "b")
    assert got.columns == ["a", "v_x", "b", "v_y"]
    assert got.first()["v_y"] == 2


def test_chain_needs_the_time_column_and_renames_sources(spark):
    def folder(name, second, value):
        return spark.createDataFrame(
            [(f"2024-01-01 00:00:0{second}", name, value)], f"__datetime string, __source string, {name} int"
        )

    got = asof_chain([folder("a", 1, 1), folder("b", 2, 2), folder("c", 3, 3)])
    assert got.columns == ["__datetime", "__source_1", "a", "__source_2", "b", "__source_3", "c"]
    assert got.select("a", "b", "c").first() == (1, 2, 3)
    with pytest.raises(ValueError, match="table 2"):
        asof_chain([folder("a", 1, 1), folder("b", 2, 2).drop("__datetime")])


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_concat_matches_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([("y", 2.5)], "s string, d double")
    got = concat_tables([a, b])
    assert got.columns == ["i", "s", "d"]
    assert rows(got) == sorted([(1, "x", None), (None, "y", 2.5)], key=repr)


KEYED = [
    pd.DataFrame({"k": ["a", "a", None, "b", "c"] + ["h"] * 20, "v": range(25)}),
    pd.DataFrame({"k": ["a", "d", None, None, "b"] + ["h"] * 3, "v": range(8)}),
    pd.DataFrame({"k": ["a", "e", None, "h", "h"], "z": range(5)}),
]


def as_spark(spark, frame):
    name = frame.columns[1]
    data = [(None if pd.isna(k) else k, int(v)) for k, v in frame.itertuples(index=False)]
    return spark.createDataFrame(data, f"k string, {name} int").repartition(4)


def plain(frame):
    def cell(x):
        return None if pd.isna(x) else x if isinstance(x, str) else int(x)

    return sorted((tuple(cell(x) for x in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("n, hot_rows", list(itertools.product((2, 3), (None, 2))))
def test_outer_join_equals_pandas(spark, n, hot_rows):
    want = KEYED[0].merge(KEYED[1], on="k", how="outer")
    if n == 3:
        want = want.merge(KEYED[2], on="k", how="outer")
    got = join_tables([as_spark(spark, f) for f in KEYED[:n]], "k", hot_rows)
    assert got.columns == (["k", "v_x", "v_y"] if n == 2 else ["k", "v_1", "v_2", "z"])
    assert rows(got) == plain(want)


def test_outer_join_needs_the_key(spark):
    with pytest.raises(ValueError, match="table 2"):
        join_tables([spark.range(1), spark.range(1).withColumnRenamed("id", "x")], "id")


def test_combine_checks_its_parameters(spark):
    a, b = spark.range(2).toDF("k"), spark.range(3).toDF("k")
    assert combine([a]).count() == 2
    assert combine([a, b]).count() == 5
    assert combine([a, b], "join", key=" k ").count() == 3
    for strategy, params in (("join", {}), ("join", {"key": " "}), ("time", {"left_time": "t"}), ("glue", {})):
        with pytest.raises(ValueError):
            combine([a, b], strategy, **params)
    with pytest.raises(ValueError):
        combine([])


@pytest.mark.parametrize("parts", [1, 4, 64])
@pytest.mark.parametrize("max_hot", [skew.MAX_HOT, 1])
def test_hot_keys_change_nothing(spark, monkeypatch, parts, max_hot):
    """A low floor, and a list of hot keys that is broadcast or joined by shuffle."""
    monkeypatch.setattr(skew, "MAX_HOT", max_hot)
    left = pd.DataFrame({"k": [1] * 40 + [2] * 30 + list(range(3, 20)), "v": range(87)})
    right = pd.DataFrame({"k": [1] * 7 + [2, 2, 25, 3], "w": range(11)})
    frames = [spark.createDataFrame(f).repartition(parts) for f in (left, right)]
    got = join_tables(frames, "k", hot_rows=5).toPandas()
    want = left.merge(right, on="k", how="outer")
    rows = lambda f: sorted(map(str, f[["k", "v", "w"]].astype(float).itertuples(index=False)))
    assert rows(got) == rows(want)


def test_the_floor_does_not_grow_with_the_table(spark):
    keys = F.when(F.col("id") < 50, 0).otherwise(F.col("id"))
    for n in (1_000, 200_000):
        hot = skew.hot_keys(spark.range(n).withColumn("k", keys), ["k"], 40)
        assert [tuple(r) for r in hot.collect()] == [(0, 2)]
    assert skew.hot_keys(spark.range(1_000).withColumn("k", keys), ["k"], 60) is None


def test_hot_keys_are_split_in_the_plan(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)], "k int, v int")
    hot = skew.hot_keys(left, ["k"], 10)
    joined = skew.lookup_join(left, spark.createDataFrame([(1, "a")], "k int, x string"), ["k"], "left", hot)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert skew.SLICE in plan and "strategy=broadcast" in plan
    assert joined.count() == 50


def test_asof_counts_each_side_once(spark):
    left, right = frames(5)
    group = "asof"
    spark.sparkContext.setJobGroup(group, group)
    asof_join(side(spark, left), side(spark, right), "t", "t", "nearest").collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 12
