import pytest
from pyspark.sql import functions as F

from plumbline.operators import diagnose as diag
from plumbline.operators import leaderboard as board
from plumbline.operators import usage as use
from plumbline.operators.metrics import classification_metrics, regression_metrics
from plumbline.plans.improving import RUN_SCHEMA


def run(spark, **values):
    names = spark.createDataFrame([], RUN_SCHEMA).columns
    row = {"n_train": 400, "n_test": 100, **values}
    return spark.createDataFrame([tuple(row.get(c) for c in names)], RUN_SCHEMA)


def checks(spark, **values):
    found = diag.diagnose(run(spark, **values)).first()
    return {c["item"]: (c["level"], c["detail"]) for c in found["checks"]}, found["verdict"]


@pytest.mark.parametrize("n, level", [(99, "critical"), (100, "warning"), (499, "warning"), (500, "ok")])
def test_sample_size(spark, n, level):
    assert checks(spark, n_train=n - 10, n_test=10)[0][diag.SAMPLE_SIZE][0] == level


@pytest.mark.parametrize("accuracy, item, level", [
    (0.996, diag.ACCURACY_TOO_HIGH, "critical"), (0.995, diag.ACCURACY, "ok"), (0.70, diag.ACCURACY, "ok"),
    (0.699, diag.ACCURACY, "warning"), (0.55, diag.ACCURACY, "warning"),
    (0.549, diag.ACCURACY_TOO_LOW, "critical"),
])
def test_accuracy(spark, accuracy, item, level):
    assert checks(spark, accuracy=accuracy)[0][item][0] == level


@pytest.mark.parametrize("r2, item, level", [
    (0.996, diag.R2_TOO_HIGH, "critical"), (0.6, diag.R2, "ok"), (0.59, diag.R2, "warning"),
    (0.3, diag.R2, "warning"), (0.29, diag.R2_TOO_LOW, "critical"), (0.0, diag.R2_TOO_LOW, "critical"),
    (-0.1, diag.R2_NEGATIVE, "critical"),
])
def test_r2(spark, r2, item, level):
    assert checks(spark, r2=r2)[0][item][0] == level


@pytest.mark.parametrize("dist, smote, balanced, level", [
    ({"a": 30, "b": 10}, False, False, None), ({"a": 31, "b": 10}, False, False, "warning"),
    ({"a": 31, "b": 10}, False, True, "ok"), ({"a": 100, "b": 10}, True, False, "ok"),
    ({"a": 101, "b": 10}, False, False, "critical"), ({"a": 101, "b": 10}, False, True, "warning"),
    ({"a": 101, "b": 10}, True, True, "ok"), ({"a": 11, "b": 0}, None, None, "critical"),
    ({"a": 500}, False, False, None),
])
def test_imbalance(spark, dist, smote, balanced, level):
    found = checks(spark, class_distribution=dist, smote=smote, balanced=balanced)[0]
    assert found.get(diag.IMBALANCE, (None,))[0] == level


def test_collinearity_lists_three_pairs(spark):
    pairs = [(f"left{i}", f"right{i}", 1 - i / 100) for i in range(1, 6)]
    found = checks(spark, high_correlation_pairs=pairs)[0][diag.COLLINEARITY]
    shown = [f"left{i}~right{i}({1 - i / 100:.2f})" for i in range(1, 4)]
    assert found == ("warning", ", ".join(shown) + " 외 2쌍")
    assert checks(spark, high_correlation_pairs=pairs[:1])[0][diag.COLLINEARITY][1] == shown[0]
    assert diag.COLLINEARITY not in checks(spark, high_correlation_pairs=[])[0]
    assert diag.COLLINEARITY not in checks(spark)[0]


@pytest.mark.parametrize("shares, fires", [
    ({"a": 86.0, "b": 14.0}, True), ({"a": 85.0, "b": 15.0}, False), ({"a": 1.0}, False),
    ({"a": 0.0, "b": 0.0}, False),
])
def test_concentration(spark, shares, fires):
    assert (diag.CONCENTRATION in checks(spark, feature_importance=shares)[0]) == fires


def test_verdicts_and_feedback(spark):
    assert checks(spark, accuracy=0.8)[1] == diag.TRUSTED
    assert checks(spark, accuracy=0.6)[1] == diag.CAUTION
    assert checks(spark, accuracy=0.5)[1] == diag.UNTRUSTED
    notes = diag.feedback(diag.diagnose(run(spark, accuracy=0.6)), ["session_id"]).collect()
    assert [(r["level"], r["item"]) for r in notes] == [("warning", diag.ACCURACY)]


def sessions(spark, *runs):
    rows = [("s", i + 1, ok, score, verdict) for i, (ok, score, verdict) in enumerate(runs)]
    return spark.createDataFrame(rows, "session_id string, round int, ok boolean, score double, verdict string")


C, T = diag.CAUTION, diag.TRUSTED


@pytest.mark.parametrize("runs, stop, best", [
    ([(True, 0.5, C), (True, 0.9, C), (True, 0.7, C)], 3, 2),
    ([(True, 0.5, C), (True, 0.5, C), (True, 0.4, C)], 3, 1),
    ([(True, 0.5, T), (True, 0.9, C)], 1, 1),
    ([(False, None, None), (True, 0.4, C), (False, None, None)], 3, 2),
    ([(True, 0.4, C), (False, None, None), (True, 0.9, C)], 2, 1),
    ([(True, None, C), (True, None, C), (True, None, C)], 3, 3),
    ([(True, None, C), (True, 0.0, C), (True, None, C)], 3, 2),
    ([(False, None, None), (False, None, None), (False, None, None)], 3, None),
    ([(True, 0.1, C), (True, 0.2, C), (True, 0.3, C), (True, 0.9, T)], 3, 3),
])
def test_stop_and_best_round(spark, runs, stop, best):
    df = sessions(spark, *runs)
    assert board.stop_round(df, ["session_id"]).first()["stop_round"] == stop
    found = board.best_run(df, ["session_id"]).first()
    assert (found["round"] if found else None) == best


@pytest.mark.parametrize("limit, stop, best", [(3, 3, 3), (5, 5, 5), (None, 5, 5), (1, 1, 1)])
def test_rounds_beyond_the_third(spark, limit, stop, best):
    df = sessions(spark, *[(True, 0.1 * i, C) for i in range(1, 6)])
    assert board.stop_round(df, ["session_id"], limit).first()["stop_round"] == stop
    assert board.best_run(df, ["session_id"], limit).first()["round"] == best


def test_different_requests_have_different_keys(spark):
    rows = [("a\x1fb", "c"), ("a", "b\x1fc"), (None, "x"), ("", "x"), ("1:a", ""), ("1", ":a"), ("N", None), (None, "N")]
    df = spark.createDataFrame(rows, "p string, q string")
    assert df.select(use.request_key("p", "q")).distinct().count() == len(rows)


def test_score_by_task(spark):
    df = spark.createDataFrame(
        [("classification", 0.7, 0.6, None), ("classification", 0.7, None, None), ("classification", 0.7, 0.0, None), ("regression", None, None, 0.3), ("timeseries", 0.9, 0.9, None)],
        "task string, accuracy double, f1 double, r2 double",
    )
    assert [r["score"] for r in board.run_score(df).collect()] == [0.6, 0.7, 0.0, 0.3, None]


def test_metrics_by_hand(spark):
    preds = spark.createDataFrame(
        [("a", "a"), ("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "label string, prediction string"
    )
    got = classification_metrics(preds).first()
    f1 = (3 * (2 * 2 / (3 + 3)) + 1 * (2 * 1 / (1 + 2)) + 0) / 5
    assert (got["accuracy"], got["n_test"]) == (0.6, 5)
    assert abs(got["f1"] - f1) < 1e-12
    numbers = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "label double, prediction double")
    got = regression_metrics(numbers).first()
    assert (got["mae"], got["r2"], got["n_test"]) == (0.5, 0.5, 2)
    flat = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "label double, prediction double")
    assert regression_metrics(flat).first()["r2"] == 0.0
    assert regression_metrics(flat.filter("prediction = 2")).first()["r2"] == 1.0


PRICES = {"oak": (2.0, 7.0), "elm": (0.5, 1.25)}


@pytest.mark.parametrize("model, tokens_in, tokens_out, cost", [
    ("oak", 3_000_000, 500_000, 9.5), ("elm", 40_000, 8_000, 0.03), ("pine", 9_000, 9_000, 0.0),
    (None, 9_000, 9_000, 0.0), ("oak", None, 0, 0.0),
])
def test_cost(spark, model, tokens_in, tokens_out, cost):
    usage = spark.createDataFrame([(model, tokens_in, tokens_out)], "model string, input_tokens bigint, output_tokens bigint")
    assert abs(use.usage_cost(usage, PRICES).first()["cost_usd"] - cost) < 1e-9


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_deltas_of_running_totals(spark, hot_rows):
    snaps = spark.createDataFrame([("a", 1, 10), ("a", 2, 25), ("b", 1, 7), ("a", 3, 25)], "s string, step int, calls bigint")
    got = use.usage_delta(snaps, ["s"], "step", ["calls"], hot_rows=hot_rows)
    assert {(r["s"], r["step"]): r["calls_delta"] for r in got.collect()} == {("a", 1): 10, ("a", 2): 15, ("a", 3): 0, ("b", 1): 7}


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_equal_requests_share_the_first_answer(spark, hot_rows):
    rows = [(1, "m", "0.2", "hi", "A"), (2, "m", "0.2", "hi", "B"), (3, "m", "0.7", "hi", "C"), (4, "n", "0.2", "hi", "D")]
    df = spark.createDataFrame(rows, "call int, model string, temperature string, text string, answer string")
    df = df.withColumn("key", use.request_key("model", "temperature", "text"))
    got = use.reuse_answers(df, "key", "call", "answer", hot_rows).orderBy("call").collect()
    assert [(r["answer"], r["reused"]) for r in got] == [("A", False), ("A", True), ("C", False), ("D", False)]
    assert df.select("key").distinct().count() == 3
    assert use.dedupe_requests(df, "key", "call").agg(F.sum("hits")).first()[0] == 1
