import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions.hashing import fold_of
from plumbline.operators import neighbors
from plumbline.operators import prepare as prep
from plumbline.operators.audit import audit_leakage
from plumbline.operators.diagnose import IMBALANCE, diagnose
from plumbline.operators.neighbors import nearest
from plumbline.operators.oversample import smote
from plumbline.operators.profile import high_corr_pairs
from plumbline.operators.split import split_random
from plumbline.plans import grams
from plumbline.plans.families import CANDIDATES, FAMILIES, Plan, candidates, estimator
from plumbline.plans.fitting import fit, importance
from plumbline.plans.improving import best_of, improve
from plumbline.plans.tuning import balanced_folds, draw_params, forward_folds, tune


def brute_force(asked, base, k, same_row):
    points, keys = base[["x", "y", "z"]].to_numpy(float), base["key"].to_numpy()
    out = {}
    for key, *v in asked[["key", "x", "y", "z"]].itertuples(index=False):
        d2 = ((points - np.array(v, float)) ** 2).sum(axis=1)
        order = [(d, b) for d, b in zip(d2, keys) if not (same_row and b == key)]
        out[key] = [b for _, b in sorted(order)[:k]]
    return out


@pytest.mark.parametrize("same_row, chunk_rows", [(False, 4000), (False, 25), (True, 25)])
def test_neighbours_equal_brute_force(spark, same_row, chunk_rows):
    rng = np.random.default_rng(7)
    frame = pd.DataFrame(rng.integers(0, 12, (260, 3)), columns=list("xyz"))
    frame.loc[100:190, ["x", "y", "z"]] = [3, 3, 3]  # a third are copies of one point
    frame["key"] = rng.permutation(len(frame))
    asked = frame if same_row else frame.assign(key=frame["key"] + 1000)
    got = nearest(
        spark.createDataFrame(asked), spark.createDataFrame(frame).withColumnRenamed("key", "base" if not same_row else "key"),
        list("xyz"), 5, "key", "key" if same_row else "base", same_row, chunk_rows=chunk_rows,
    )
    first, second = ("query", "neighbor") if same_row else ("key", "base")
    found = {}
    for r in got.orderBy("rank").collect():
        found.setdefault(r[first], []).append(r[second])
    assert found == brute_force(asked, frame, 5, same_row)


def points(spark, n=300, classes=2):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 2))
    y = (x[:, 0] + x[:, 1] > 0.8).astype(int) + (classes > 2) * (x[:, 0] < -0.8).astype(int) * 2
    frame = pd.DataFrame({"id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "y": [f"c{v}" for v in y]})
    return split_random(spark.createDataFrame(frame), "id")


def parts(df):
    return df.filter("part = 'train'").drop("part"), df.filter("part = 'test'").drop("part")


def test_oversampling_evens_out_the_classes(spark):
    train, _ = parts(points(spark))
    got = smote(train, ["a", "b"], "y", "id")
    sizes = {r["y"]: r["count"] for r in got.groupBy("y").count().collect()}
    assert len(set(sizes.values())) == 1
    made = got.filter("synthetic")
    small = train.filter("y = 'c1'")
    low, high = small.agg(F.min("a"), F.max("a")).first()
    assert made.count() > 0 and made.filter(~F.col("a").between(low, high)).count() == 0
    assert made.filter("id IS NOT NULL").count() == 0
    assert made.join(small.select(F.col("id").alias("origin")), "origin", "left_anti").count() == 0
    again = smote(train.repartition(5), ["a", "b"], "y", "id").filter("synthetic")
    assert sorted(map(str, again.select("a", "b").collect())) == sorted(map(str, made.select("a", "b").collect()))


def test_oversampling_a_single_row(spark):
    df = spark.createDataFrame([(i, float(i), "a") for i in range(9)] + [(9, 5.0, "b")], "id int, a double, y string")
    got = smote(df, ["a"], "y", "id")
    assert {tuple(r) for r in got.filter("y = 'b'").select("a").distinct().collect()} == {(5.0,)}
    assert got.filter("y = 'b'").count() == 9


@pytest.mark.parametrize(
    "family, classes",
    [(f, 2) for f in FAMILIES["classification"]] + [("gradient_boosting", 3), ("svm", 3)],
)
def test_families_learn(spark, family, classes):
    train, test = parts(points(spark, classes=classes))
    preds = fit(Plan(family, "classification", "y", ("a", "b"), "id"), train).predict(test)
    assert preds.columns == ["id", "label", "prediction"]
    assert preds.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0] > 0.75


def test_plans_are_checked(spark):
    with pytest.raises(ValueError):
        Plan("knn", "regression", "y", ("a",), "id")
    with pytest.raises(ValueError):
        Plan("ridge", "clustering", "y", ("a",), "id")
    for task in CANDIDATES:
        plans = candidates(task, "y", ["a"], "id")
        assert len({p.family for p in plans}) == 3
        assert all(estimator(p.family, task) is not None for p in plans)


def test_importance_names_features(spark):
    train, _ = parts(points(spark))
    found = importance(fit(Plan("random_forest", "classification", "y", ("a", "b"), "id"), train))
    assert {r["feature"] for r in found.collect()} == {"a", "b"}
    assert importance(fit(Plan("naive_bayes", "classification", "y", ("a", "b"), "id"), train)) is None


def test_search_is_repeatable(spark):
    assert draw_params("random_forest") == draw_params("random_forest")
    assert len(draw_params("random_forest")) == 20
    train, _ = parts(points(spark, 120))
    plan = Plan("decision_tree", "classification", "y", ("a", "b"), "id")
    best, table = tune(plan, train, draws=4)
    rows = table.collect()
    assert len(rows) == 4 and sum(r["best"] for r in rows) == 1
    assert str(best.params) == next(r["params"] for r in rows if r["best"])
    assert max(r["score"] for r in rows) == next(r["score"] for r in rows if r["best"])


def planted(spark, n=240):
    """A rare class of few rows, near enough for synthetic rows between all of them."""
    return spark.range(n).select(
        "id", (F.col("id") % 17 * 1.0).alias("a"), (F.col("id") * 7 % 23 * 1.0).alias("b"), F.expr("IF(id % 8 = 0, 'rare', 'usual')").alias("y")
    )


def test_remedies_stay_inside_the_folds(spark):
    plan, rows = Plan("decision_tree", "classification", "y", ("a", "b"), "id"), planted(spark)

    def leaks(past, test):
        return audit_leakage(past, test, "id", "origin").agg(F.sum("n")).first()[0]

    fold = fold_of("id", folds=3, seed=42)
    before = smote(rows, ["a", "b"], "y", "id")  # planted: made before the folds are cut
    assert leaks(before.filter(F.col("synthetic") | (fold != 0)), rows.filter(fold == 0)) > 0
    for past, test in balanced_folds(plan, rows, "synthetic"):
        assert leaks(past, test) == 0 and "synthetic" not in test.columns
        assert past.filter("synthetic").count() > 0
        assert past.groupBy("y").count().select("count").distinct().count() == 1
    seen = 0
    for past, test in balanced_folds(plan, rows, "weights"):
        totals = past.groupBy("y").agg(F.sum("__weight").alias("w")).collect()
        assert len({round(r["w"], 6) for r in totals}) == 1 and past.join(test, "id").count() == 0
        seen += test.count()
    assert seen == rows.count()


def test_search_scores_what_is_fitted(spark):
    plan, rows = Plan("decision_tree", "classification", "y", ("a", "b"), "id"), planted(spark)
    best, table = tune(plan, rows, draws=3, folds=2, balance="weights")
    scores = []
    for past, test in balanced_folds(plan, rows, "weights", 2):
        preds = fit(best, past, "__weight").predict(test)
        scores.append(preds.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0])
    assert table.filter("best").first()["score"] == pytest.approx(np.mean(scores))
    assert table.count() == 3
    assert tune(plan, rows, draws=2, folds=2, balance="synthetic")[1].filter("score BETWEEN 0 AND 1").count() == 2
    with pytest.raises(ValueError, match="balance"):
        tune(plan, rows, balance="more")
    with pytest.raises(ValueError, match="balance"):
        tune(Plan("ridge", "regression", "a", ("b",), "id"), rows, balance="weights")


def test_forward_folds_never_look_ahead(spark):
    df = spark.range(100).select(F.timestamp_seconds("id").cast("timestamp_ntz").alias("t"), (F.col("id") * 1.0).alias("x"), "id")
    folds = forward_folds(df, "t").groupBy("fold").agg(F.min("t"), F.max("t")).orderBy("fold").collect()
    assert [r["fold"] for r in folds] == [0, 1, 2, 3]
    assert all(a[2] < b[1] for a, b in zip(folds, folds[1:]))
    plan = Plan("ridge", "timeseries", "x", ("id",), "id", "t")
    assert tune(plan, df, draws=2)[1].count() == 2


def test_improvement_loop(spark):
    train, test = parts(points(spark, 700))
    good = improve(Plan("decision_tree", "classification", "y", ("a", "b"), "id"), train, test, draws=2, folds=2, preprocessing=("scaled",))
    row = good.first()
    assert row["cv_score"] > 0.5 and set(row["best_params"]) == {"maxDepth", "minInstancesPerNode"} and row["preprocessing"][0] == "scaled"
    assert 1 <= good.count() <= 3
    best = best_of(good).first()
    assert best["score"] == good.agg(F.max("score")).first()[0]
    missing = improve(Plan("decision_tree", "classification", "y", ("none",), "id"), train, test, draws=0)
    assert [r["ok"] for r in missing.collect()] == [False] * 3
    assert all("none" in r["error"] for r in missing.collect())
    assert best_of(missing).count() == 0


def test_collinear_columns_become_components(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=300)
    frame = pd.DataFrame({"a": a, "b": 2 * a + 0.01 * rng.normal(size=300) + 5, "c": rng.normal(size=300)})
    df = spark.createDataFrame(frame)
    got = prep.collinear_components(df, high_corr_pairs(df))
    assert got.columns == ["c", "pca_1"]
    first = np.array([r["pca_1"] for r in got.orderBy("c").collect()])
    assert abs(np.corrcoef(first, frame.sort_values("c")["a"])[0, 1]) > 0.999
    assert abs(first.mean()) < 1e-9
    assert prep.collinear_components(df.select("c"), high_corr_pairs(df.select("c"))).columns == ["c"]


def test_named_steps_count_as_mitigation(spark):
    run = {"n_train": 500, "n_test": 100, "class_distribution": {"a": 500, "b": 20}}
    for steps, level in ((["SMOTE"], "ok"), (["balanced class weights"], "warning"), (["scaled"], "critical"), (None, "critical")):
        row = spark.createDataFrame([(500, 100, run["class_distribution"], steps)], "n_train int, n_test int, class_distribution map<string,bigint>, preprocessing array<string>")
        found = {c["item"]: c["level"] for c in diagnose(row).first()["checks"]}
        assert found[IMBALANCE] == level


@pytest.mark.parametrize("name", ["improve", "improve_checks"])
def test_registered_rounds_search_as_much_as_the_operator(spark, monkeypatch, name):
    from plumbline.catalog import QUERIES
    from plumbline.plans import improving, tuning

    asked = []

    def search(plan, train, draws, folds, balance=None):
        asked.append((draws, folds))
        raise RuntimeError("enough")

    monkeypatch.setattr(improving, "tune", search)
    with pytest.raises(RuntimeError, match="enough"):
        QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert asked == [(tuning.DRAWS, tuning.FOLDS)]


@pytest.mark.parametrize(("kind", "most"), [("uncorrelated", 0.10), ("clustered", 0.02)])
def test_few_distances_are_computed(spark, kind, most):
    """Twelve features, compared pairs counted, neighbours those of all pairs."""
    rng = np.random.default_rng(11)
    n, width, k = 100_000, 12, 5
    x = rng.random((n, width)) if kind == "uncorrelated" else 10 * rng.normal(size=(200, width))[rng.integers(0, 200, n)] + rng.normal(size=(n, width))
    names = [f"f{i}" for i in range(width)]
    base = pd.DataFrame(x, columns=names).assign(base=np.arange(n))
    asked = base.iloc[:: n // 200].rename(columns={"base": "key"})
    counter = spark.sparkContext.accumulator(0)
    table = spark.createDataFrame(base).repartition(8)
    got = nearest(spark.createDataFrame(asked), table, names, k, "key", "base", chunk_rows=8192, compared=counter).collect()
    assert k * len(asked) < counter.value < most * n * len(asked)
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["key"], []).append(r["base"])
    for key, v in zip(asked["key"], asked[names].to_numpy()):
        d2 = ((x - v) ** 2).sum(axis=1)
        assert found[key] == np.lexsort((np.arange(n), d2))[:k].tolist()


def test_box_trees():
    rng = np.random.default_rng(12)
    for n, width, cells in [(0, 2, 5), (1, 1, 4), (700, 3, 16), (400, 2, 100)]:
        sample = np.round(rng.normal(size=(n, width)), 1)
        tree = neighbors.cuts(sample, cells)
        number = neighbors.cell_of(rng.normal(size=(500, width)), tree)
        assert len(tree) < cells and set(number.tolist()) <= set(range(len(tree) + 1))
        sizes = np.bincount(neighbors.cell_of(sample, tree), minlength=1)
        assert n < 700 or sizes.max() < 3 * n / cells
    places = neighbors.split(np.zeros((100, 2)), 16)
    assert sorted(np.concatenate(places).tolist()) == list(range(100)) and max(map(len, places)) <= 16
    points, low, high = np.array([[0.0, 5.0], [2.0, 2.0]]), np.array([[1.0, 1.0]]), np.array([[3.0, 3.0]])
    assert neighbors.box_distance(points, low, high).tolist() == [[5.0], [0.0]]


def test_a_cell_with_many_rows_is_cut_into_slices(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "CELLS", 2)
    rng = np.random.default_rng(13)
    x = rng.integers(0, 40, (900, 2)).astype(float)
    base = spark.createDataFrame([(i, *v) for i, v in enumerate(x.tolist())], "base int, a double, b double")
    asked = spark.createDataFrame([(i, *v) for i, v in enumerate(x[:60].tolist())], "key int, a double, b double")
    got = {(r["key"], r["rank"]): r["base"] for r in nearest(asked, base, ["a", "b"], 4, "key", "base", chunk_rows=50).collect()}
    for key in range(60):
        d2 = ((x - x[key]) ** 2).sum(axis=1)
        assert [got[key, i + 1] for i in range(4)] == np.lexsort((np.arange(900), d2))[:4].tolist()
    assert nearest(asked, base.filter("false"), ["a", "b"], 4, "key", "base").count() == 0


def test_every_family_draws_twenty_settings():
    for family in {f for of in FAMILIES.values() for f in of} - {"knn"}:
        drawn = draw_params(family)
        assert len(drawn) == len({str(s) for s in drawn}) == 20 and drawn == draw_params(family), family


def correlated(spark, n=400):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(n, 3)) * [1, 50, 0.01] + [1e4, -3, 0]
    x[:, 2] += 0.02 * (x[:, 0] - 1e4)
    y = 3 * x[:, 0] - 0.2 * x[:, 1] + rng.normal(size=n) + 100
    frame = pd.DataFrame({"id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "same": 5.0, "y": y})
    return spark.createDataFrame(frame).withColumn("t", F.timestamp_seconds("id").cast("timestamp_ntz")).repartition(5)


@pytest.mark.parametrize("family", grams.FAMILIES)
@pytest.mark.parametrize("task", ["regression", "timeseries"])
def test_one_pass_scores_equal_fits_one_by_one(spark, family, task):
    if family not in FAMILIES[task]:
        return
    df = correlated(spark)
    plan = Plan(family, task, "y", ("a", "b", "c", "same"), "id", "t")
    found = tune(plan, df, draws=4)[1].orderBy("draw").collect()
    if task == "timeseries":
        dealt = forward_folds(df, "t")
        parts = [(dealt.filter(F.col("fold") < i), dealt.filter(F.col("fold") == i)) for i in (1, 2, 3)]
    else:
        dealt = df.withColumn("fold", fold_of("id", folds=3, seed=42))
        parts = [(dealt.filter(F.col("fold") != i), dealt.filter(F.col("fold") == i)) for i in range(3)]
    for r, s in zip(found, draw_params(family, 4)):
        assert r["params"] == str(s)
        total = 0.0
        for past, test in parts:
            predicted = fit(Plan(family, task, "y", plan.features, "id", "t", params=s), past).predict(test).toPandas()
            rest = ((predicted["label"] - predicted["prediction"]) ** 2).sum()
            total += 1 - rest / ((predicted["label"] - predicted["label"].mean()) ** 2).sum()
        assert r["score"] == pytest.approx(total / 3, abs=2e-4), s


def test_a_search_of_a_linear_family_takes_one_pass(spark):
    df = correlated(spark)
    reads = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        reads.add(1)
        return v

    rows = df.select("id", "a", "b", "c", counted("y").alias("y"))
    plan = Plan("ridge", "regression", "y", ("a", "b", "c"), "id")
    table = tune(plan, rows)[1]
    assert table.count() == 20 and table.filter("best").count() == 1
    assert 400 <= reads.value <= 2 * 400  # the sums of each row, and the first rows for the centre


def test_smoothed_variances(spark):
    train, test = parts(points(spark))
    plain, same, wide = (
        fit(Plan("naive_bayes", "classification", "y", ("a", "b"), "id", params=p), train) for p in ({}, {"varSmoothing": 0.0}, {"varSmoothing": 0.5})
    )
    assert sorted(map(tuple, plain.predict(test).collect())) == sorted(map(tuple, same.predict(test).collect()))
    variances = plain.model.sigma.toArray()
    assert np.allclose(wide.model.sigma.toArray(), variances + 0.5 * variances.max())
    x = np.array([[r["a"], r["b"]] for r in test.orderBy("id").collect()])
    means, v, prior = wide.model.theta.toArray(), wide.model.sigma.toArray(), wide.model.pi.toArray()
    logs = prior - 0.5 * (np.log(v)[None] + (x[:, None] - means) ** 2 / v).sum(axis=2)
    assert [r["prediction"] for r in wide.predict(test).orderBy("id").collect()] == [wide.labels[i] for i in logs.argmax(axis=1)]
    best, table = tune(Plan("naive_bayes", "classification", "y", ("a", "b"), "id"), train, draws=3)
    assert table.count() == 3 and set(best.params) == {"varSmoothing"}


def test_cells_are_computed_once(spark):
    """Each evaluation in a task takes one more Python worker, and their memory adds up."""
    rows = spark.range(600).select("id", (F.col("id") * 7 % 101 * 1.0).alias("a"), (F.col("id") * 13 % 89 * 1.0).alias("b"))
    found = nearest(rows, rows, ["a", "b"], 3, "id", "id", same_row=True, chunk_rows=64)
    lines = [x.strip(" :+-") for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    steps = [x for x in lines if x.startswith(("ArrowEvalPython", "Join"))]
    assert any("home_of" in x for x in steps) and any("reached" in x for x in steps)
    # a function evaluated again for a filter stands right below itself
    assert not any(a.startswith("Arrow") and b.startswith("Arrow") and a.split("(")[0] == b.split("(")[0] for a, b in zip(steps, steps[1:]))
