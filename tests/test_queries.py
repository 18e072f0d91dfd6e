"""Every registered query against its SQL twin on whole tables."""

import os

import pytest
from oracle import compare, duck

from plumbline.catalog import ORACLE, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(ORACLE))
def test_same_rows_as_sql(spark, con, name):
    assert compare(spark, con, name, SF_DIR) == []


@pytest.mark.parametrize("name", ["fit_random_forest", "fit_svm", "fit_regression_lasso", "fit_timeseries_ridge"])
def test_models_predict_every_test_row(spark, name):
    preds = QUERIES[name](spark, SF_DIR)
    assert preds.count() > 0
    assert preds.filter("prediction IS NULL").count() == 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
