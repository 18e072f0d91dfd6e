import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import audit, series, split


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(6)
    n = 300
    t = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 200, n), unit="s")
    frame = pd.DataFrame({"i": np.arange(n), "t": t, "g": rng.choice([0, 0, 0, 1, 2], n), "x": rng.normal(size=n)})
    return frame.sort_values(["t", "i"]).reset_index(drop=True)


def as_spark(spark, frame, parts=3):
    df = spark.createDataFrame(frame).withColumn("t", F.col("t").cast("timestamp_ntz"))
    return df.repartition(parts)


def expected(frame, keys):
    x = frame.groupby("g")["x"] if keys else frame["x"]
    want = frame.copy()
    for k in (1, 2, 3, 7):
        want[f"x_lag_{k}"] = x.shift(k)
    for w in (3, 7):
        for name in ("mean", "std"):
            rolled = (lambda s: getattr(s.shift(1).rolling(w), name)())
            want[f"x_{name}_{w}"] = x.transform(rolled) if keys else rolled(x)
    return want.sort_values("i").reset_index(drop=True)


@pytest.mark.parametrize("keys, options, parts", [
    ([], {"chunk_rows": 20}, 1), ([], {}, 5), (["g"], {}, 4), (["g"], {"chunk_rows": 16, "hot_rows": 10}, 5),
])
def test_features_equal_pandas(spark, frame, keys, options, parts):
    df = as_spark(spark, frame, parts)
    lagged = series.lags(df, "x", "t", by=keys, tiebreak=["i"], **options)
    rolled = series.rolling(df, "x", "t", by=keys, tiebreak=["i"], **options)
    want = expected(frame, keys)
    for got in (lagged.toPandas(), rolled.toPandas()):
        got = got.sort_values("i").reset_index(drop=True)
        assert len(got) == len(frame)
        for c in [c for c in got.columns if c.startswith("x_")]:
            np.testing.assert_allclose(got[c].astype(float), want[c], rtol=1e-9, atol=1e-9)


def test_complete_features_drop_time_and_short_history(spark, frame):
    got = series.ts_features(as_spark(spark, frame), "x", "t", tiebreak=["i"])
    assert "t" not in got.columns and {"year", "month", "day", "dayofweek"} <= set(got.columns)
    assert got.count() == len(frame) - 7


def test_calendar_starts_the_week_on_monday(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-07",), ("x",)], "t string")
    got = [tuple(r)[1:] for r in series.calendar(df, "t").collect()]
    assert got == [(2024, 1, 1, 0), (2024, 1, 7, 6), (None, None, None, None)]


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_splits_do_not_depend_on_partitions(spark, frame, parts):
    df = as_spark(spark, frame, parts)
    by_key = split.split_random(df, "i").filter("part = 'test'")
    by_time = split.split_time(df, "t").filter("part = 'test'")
    assert sorted(r["i"] for r in by_key.collect()) == sorted(
        r["i"] for r in split.split_random(as_spark(spark, frame, 2), "i").filter("part = 'test'").collect()
    )
    cut = frame["t"].iloc[len(frame) - 60 - 1]
    assert by_time.count() == (frame["t"] > cut).sum()


def level(df):
    return [(r["level"], r["n"]) for r in df.collect()]


def test_audits_find_planted_faults(spark):
    train = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k int, t int")
    test = spark.createDataFrame([(4, 40), (5, 50)], "k int, t int")
    assert level(audit.audit_leakage(train, test, "k")) == [("ok", 0)]
    assert level(audit.audit_leakage(train, test.union(train.filter("k = 1")).union(train.filter("k = 1")), "k")) == [("critical", 2)]
    assert level(audit.audit_cv(train, train, "k")) == [("ok", 0)]
    assert level(audit.audit_cv(train.union(test), train, "k")) == [("critical", 2)]
    assert level(audit.audit_eval(train, train, test, "k")) == [("critical", 3)]
    assert level(audit.audit_eval(train.union(test), train, test, "k")) == [("ok", 0)]
    assert level(audit.audit_time_split(train, test, "t")) == [("ok", 0)]
    assert level(audit.audit_time_split(test, train, "t")) == [("critical", 2)]
    assert level(audit.audit_time_split(test, train, "t", "regression")) == [("ok", 0)]
    made = test.withColumn("made", F.col("k") == 4)
    assert level(audit.audit_oversample(made, "made")) == [("critical", 1)]
    assert level(audit.audit_oversample(made, "made", "regression")) == [("ok", 0)]


def test_repeatable_split_is_recognised(spark):
    df = spark.range(200).toDF("k")
    stored = split.split_random(df, "k")
    assert level(audit.audit_repro(df, stored, "k")) == [("ok", 0)]
    assert level(audit.audit_repro(df, stored.filter("k > 4"), "k")) == [("critical", 5)]
    assert level(audit.audit_repro(df, split.split_random(df, "k", seed=1), "k"))[0][0] == "critical"


def test_audits_follow_the_task(spark):
    df = split.split_random(spark.range(50).select(F.col("id").alias("k"), F.col("id").alias("t")), "k")
    train, test = df.filter("part = 'train'"), df.filter("part = 'test'")
    names = [r["audit"] for r in audit.run_audits(df, "k", train, test, preds=test, folds=train).collect()]
    assert names == ["leakage", "cv_integrity", "evaluation", "reproducibility"]
    names = [r["audit"] for r in audit.run_audits(df, "k", train, test, "timeseries", time="t").collect()]
    assert names == ["leakage", "time_split"]
