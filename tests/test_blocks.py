"""Rows with equal features are taken together before models pass over them."""

import numpy as np
import pytest

from plumbline.catalog import modelling
from plumbline.operators import profile
from plumbline.plans import blocks, fitting, fourier, newton
from plumbline.plans.families import Plan
from plumbline.plans.fitting import fit


@pytest.fixture(scope="module")
def repeated(spark):
    """600 rows of 12 different features."""
    return spark.range(600).selectExpr("id", "cast(id % 4 as double) a", "cast(id % 3 as double) b", "id % 4 * 10 + id % 3 + id % 7 y")


@pytest.mark.parametrize("family", fitting.BY_MEANS)
def test_trees_from_means_of_equal_rows(spark, repeated, monkeypatch, family):
    plan = Plan(family, "regression", "y", ("a", "b"), "id", params={"maxDepth": 2})
    rows = fitting.with_label(fitting.assembled(repeated, ["a", "b"]), plan, [])
    assert fitting.merged(rows).count() == 12
    few = {r["id"]: r["prediction"] for r in fit(plan, repeated).predict(repeated).collect()}
    monkeypatch.setattr(fitting, "BY_MEANS", ())
    every = {r["id"]: r["prediction"] for r in fit(plan, repeated).predict(repeated).collect()}
    assert few == pytest.approx(every, rel=1e-9)


def test_different_rows_are_not_merged_and_missing_labels_stay(spark):
    plan = Plan("decision_tree", "regression", "y", ("a",), "id")
    one = spark.range(100).selectExpr("id", "cast(id as double) a", "id y")
    assert fitting.merged(fitting.with_label(fitting.assembled(one, ["a"]), plan, [])) is None
    gone = spark.range(100).selectExpr("id", "1D a", "if(id = 3, null, id) y")
    found = fitting.merged(fitting.with_label(fitting.assembled(gone, ["a"]), plan, [])).collect()
    assert sorted((r["label"] is None, r["__rows"]) for r in found) == [(False, 99.0), (True, 1.0)]


def test_codes_of_equal_rows_are_combined():
    codes = np.array([[1, 2], [1, 2], [0, 2], [1, 2], [0, 2]], np.uint8)
    y, w = np.array([1.0, 3.0, 5.0, 1.0, 5.0]), np.array([1.0, 1.0, 2.0, 2.0, 2.0])
    got = newton.combined(codes, y, w, True)
    assert sorted(zip(map(tuple, got[0].tolist()), got[1], got[2])) == [((0, 2), 5.0, 4.0), ((1, 2), 1.5, 4.0)]
    assert len(newton.combined(codes, y, w, False)[1]) == 5  # three kinds of five are not half
    twice = newton.combined(*(np.concatenate([v, v]) for v in (codes, y, w)), False)
    assert sorted(zip(map(tuple, twice[0].tolist()), twice[1], twice[2])) == [((0, 2), 5.0, 8.0), ((1, 2), 1.0, 6.0), ((1, 2), 3.0, 2.0)]


def test_sums_outside_the_tube_by_kinds():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (200, 3)).astype(float)
    z, y, w, v = x + 0.5, rng.normal(size=200), rng.uniform(1, 2, 200), rng.normal(size=3)
    places, kind = blocks.distinct(x)
    assert len(places) <= 27 and (x[places][kind] == x).all()
    each = fourier.outside(z, np.arange(200), y, w, v, 0.3)
    assert fourier.outside(z[places], kind, y, w, v, 0.3) == pytest.approx(each, rel=1e-9)


def test_checks_make_the_features_once(spark, monkeypatch, tmp_path):
    made = []
    rows = spark.range(300).selectExpr("id event_id", "timestamp_seconds(id * 3600) ts", "cast(id % 11 as double) value")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    real = modelling.TASK_ROWS["timeseries"]
    monkeypatch.setitem(modelling.TASK_ROWS, "timeseries", lambda *a: made.append(1) or real(*a))
    monkeypatch.setitem(modelling.FAMILIES, "timeseries", ("ridge", "decision_tree"))
    found = modelling.fit_checks_timeseries(spark, str(tmp_path)).collect()
    assert len(found) == 2 and made == [1]


def test_wide_correlations_run_as_compiled_methods(spark, monkeypatch):
    limits, real = [], profile.materialize
    monkeypatch.setattr(profile, "materialize", lambda df: limits.append(spark.conf.get(profile.METHOD_LIMIT)) or real(df))
    before = spark.conf.get(profile.METHOD_LIMIT)
    rows = spark.range(50).selectExpr("cast(id as double) a", "2D * id b", "if(id % 5 = 0, null, -id) c")
    found = {(r["a"], r["b"]): r["corr"] for r in profile.correlations(rows, ["a", "b", "c"]).collect()}
    assert found == pytest.approx({("a", "b"): 1, ("a", "c"): -1, ("b", "c"): -1})
    assert limits == ["8000"] and spark.conf.get(profile.METHOD_LIMIT) == before
