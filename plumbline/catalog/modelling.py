"""Queries on models: families, tuning, oversampling and the improvement loop."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.catalog.registry import ORACLE, QUERIES, query, table
from plumbline.operators import series, split
from plumbline.operators.asof import asof_join
from plumbline.operators.durable import materialize
from plumbline.operators.diagnose import check_rows, diagnose
from plumbline.operators.metrics import regression_metrics
from plumbline.operators.oversample import smote
from plumbline.plans.families import CANDIDATES, FAMILIES, Plan, candidates
from plumbline.plans.fitting import fit, importance
from plumbline.plans.improving import best_of
from plumbline.plans.improving import improve as improve_plan
from plumbline.plans.tuning import tune

DOC_FEATURES = ["n_chars", "n_words", "n_lines", "n_digits"]
ITEM_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]

DOCS_SQL = """
    d AS (SELECT d.doc_id, CAST(quality AS INTEGER) AS quality, toxic, n_chars,
                 length(text) - length(replace(text, ' ', '')) + 1 AS n_words,
                 length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines,
                 length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS n_digits,
                 ('0x' || substr(md5(d.doc_id || '42'), 1, 8))::UBIGINT / 4294967296.0 < 0.2 AS in_test
          FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
    """


def document_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with counts taken from their whole text."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")

    def lost(pattern: str):
        return F.length("text") - F.length(F.regexp_replace("text", pattern, ""))

    counted = docs.select(
        "doc_id", "n_chars", (lost(" ") + 1).alias("n_words"), (lost("\n") + 1).alias("n_lines"),
        lost("[0-9]").alias("n_digits"),
    )
    return split.split_random(counted.join(labels, "doc_id"), "doc_id")


def _parts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("part = 'train'"), df.filter("part = 'test'")


def _doc_plan(family: str) -> Plan:
    return Plan(family, "classification", "quality", tuple(DOC_FEATURES), "doc_id")


def _register_fits() -> None:
    """One query per family and task: a prediction for every test row."""

    def maker(task: str, family: str):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            rows = TASK_ROWS[task](spark, sf_dir)
            train, test = _parts(rows)
            return fit(TASK_PLANS[task](family, rows), train).predict(test)

        return run

    for task, prefix in (("classification", "fit"), ("regression", "fit_regression"), ("timeseries", "fit_timeseries")):
        for family in FAMILIES[task]:
            if (task, family) != ("classification", "knn"):
                QUERIES[f"{prefix}_{family}"] = maker(task, family)


def item_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("row_id", F.col("l_orderkey") * 16 + F.col("l_linenumber"))
    return split.split_random(rows, "row_id")


def _item_plan(family: str) -> Plan:
    return Plan(family, "regression", "l_extendedprice", tuple(ITEM_FEATURES), "row_id")


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    built = series.ts_features(rows, "value", "ts", tiebreak=["event_id"], keep_time=True)
    return split.split_time(materialize(built), "ts")


def _event_plan(family: str, rows: DataFrame) -> Plan:
    features = [c for c in rows.columns if c not in ("event_id", "ts", "value", "part")]
    return Plan(family, "timeseries", "value", tuple(features), "event_id", "ts")


# The rows of each task, split, and the plan of a family on them.
TASK_ROWS = {"classification": document_features, "regression": item_features, "timeseries": event_features}
TASK_PLANS = {
    "classification": lambda family, rows: _doc_plan(family), "regression": lambda family, rows: _item_plan(family),
    "timeseries": _event_plan,
}
_register_fits()


@query(
    f"""
    WITH {DOCS_SQL},
         near AS (SELECT a.doc_id, a.quality AS label, b.quality AS c,
                         row_number() OVER (PARTITION BY a.doc_id ORDER BY
                             (a.n_chars - b.n_chars) ** 2 + (a.n_words - b.n_words) ** 2
                             + (a.n_lines - b.n_lines) ** 2 + (a.n_digits - b.n_digits) ** 2,
                             b.doc_id) AS r
                  FROM d a JOIN d b ON a.in_test AND NOT b.in_test),
         votes AS (SELECT doc_id, label, c, count(*) AS n FROM near WHERE r <= 5 GROUP BY ALL)
    SELECT doc_id, any_value(label) AS label, arg_max(c, n * 1000 - c) AS prediction
    FROM votes GROUP BY doc_id
    """
)
def fit_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _parts(document_features(spark, sf_dir))
    return fit(_doc_plan("knn"), train).predict(test)


@query(
    """
    SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
           round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept
    FROM lineitem
    """
)
def ols_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label"))
    rows = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(items)
    model = LinearRegression(solver="normal").fit(rows)
    return spark.createDataFrame(
        [(round(float(model.coefficients[0]), 4), round(float(model.intercept), 4))],
        "slope double, intercept double",
    )


@query(
    f"""
    WITH {DOCS_SQL}, c AS (SELECT toxic, count(*) AS n FROM d WHERE NOT in_test GROUP BY 1)
    SELECT toxic, FALSE AS synthetic, n FROM c
    UNION ALL
    SELECT toxic, TRUE, (SELECT max(n) FROM c) - n FROM c WHERE n < (SELECT max(n) FROM c)
    """
)
def smote_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _parts(document_features(spark, sf_dir))
    balanced = smote(train, DOC_FEATURES, "toxic", "doc_id")
    return balanced.groupBy("toxic", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@query()
def smote_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _parts(document_features(spark, sf_dir))
    balanced = smote(train, DOC_FEATURES, "toxic", "doc_id")
    return balanced.select("origin", "synthetic", "toxic", *[F.round(c, 6).alias(c) for c in DOC_FEATURES])


@query()
def tune_decision_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _parts(document_features(spark, sf_dir))
    return tune(_doc_plan("decision_tree"), train)[1]


@query()
def tune_timeseries_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_features(spark, sf_dir)
    return tune(_event_plan("ridge", rows), _parts(rows)[0])[1]


@query()
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _parts(document_features(spark, sf_dir))
    return importance(fit(_doc_plan("random_forest"), train))


@query()
def candidate_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three candidates for document quality, each fitted and measured by error rate."""
    train, test = _parts(document_features(spark, sf_dir))
    plans = candidates("classification", "quality", DOC_FEATURES, "doc_id")
    assert [p.family for p in plans] == list(CANDIDATES["classification"])
    parts = [
        fit(p, train).predict(test).agg(
            F.lit(i + 1).alias("rank"), F.lit(p.family).alias("family"),
            F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"),
        )
        for i, p in enumerate(plans)
    ]
    return reduce(DataFrame.unionByName, parts)


@query()
def improve(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _parts(document_features(spark, sf_dir))
    plan = Plan("logistic_regression", "classification", "toxic", tuple(DOC_FEATURES), "doc_id")
    runs = improve_plan(plan, train, test)
    return runs.select(
        "session_id", "round", "family", "remedy", "ok", "accuracy", "f1", "score", "verdict",
        F.size("checks").alias("n_checks"),
    )


@query(
    """
    WITH p AS (SELECT ts, event_id, value FROM events WHERE event_type = 'purchase'),
         v AS (SELECT ts, event_id AS view_id, value AS view_value FROM events WHERE event_type = 'view'),
         b AS (SELECT p.*, v.ts AS v_ts, view_value FROM p ASOF LEFT JOIN v ON p.ts >= v.ts),
         f AS (SELECT p.*, v.ts AS v_ts, view_value FROM p ASOF LEFT JOIN v ON p.ts <= v.ts),
         n AS (SELECT b.ts, b.event_id, b.value,
                      CASE WHEN f.v_ts IS NULL OR b.ts - b.v_ts <= f.v_ts - b.ts
                           THEN b.view_value ELSE f.view_value END AS view_value,
                      least(b.ts - b.v_ts, f.v_ts - b.ts) AS gap
               FROM b JOIN f ON b.event_id = f.event_id),
         w AS (SELECT *, CASE WHEN gap <= INTERVAL 1 HOUR THEN view_value END AS seen,
                      CASE WHEN count(value) OVER past = 7 THEN avg(value) OVER past END AS mean_7,
                      lag(value, 7) OVER (ORDER BY ts, event_id) AS lag_7
               FROM n WINDOW past AS (ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
         x AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS total
               FROM w WHERE mean_7 IS NOT NULL AND lag_7 IS NOT NULL),
         t AS (SELECT *, (mean_7 + coalesce(seen, mean_7)) / 2 AS guess FROM x
               WHERE rn > total - ceil(total * 0.2)),
         m AS (SELECT count(*) AS n_test, any_value(total) - count(*) AS n_train,
                      1 - avg((value - guess) ** 2) / var_pop(value) AS r2 FROM t)
    SELECT CASE WHEN n_train + n_test < 100 THEN 'critical' WHEN n_train + n_test < 500 THEN 'warning'
                ELSE 'ok' END AS level, '샘플 수' AS item, CAST(n_train + n_test AS DOUBLE) AS value FROM m
    UNION ALL
    SELECT CASE WHEN r2 > 0.995 OR r2 < 0.3 THEN 'critical' WHEN r2 < 0.6 THEN 'warning' ELSE 'ok' END,
           CASE WHEN r2 > 0.995 THEN 'R² 과도' WHEN r2 < 0 THEN 'R² 음수'
                WHEN r2 < 0.3 THEN '설명력 부족' ELSE '설명력' END, round(r2, 6) FROM m
    """
)
def forecast_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with their nearest view, rolling features, time split, metrics, checks."""
    events = table(spark, sf_dir, "events")
    purchases = events.filter("event_type = 'purchase'").select("ts", "event_id", "value")
    views = events.filter("event_type = 'view'").select("ts", F.col("value").alias("seen"))
    joined = asof_join(purchases, views, "ts", "ts", "nearest", tolerance_seconds=3600)
    built = series.ts_features(
        joined, "value", "ts", steps=(7,), widths=(7,), tiebreak=["event_id"], keep_time=True
    )
    train, test = _parts(split.split_time(materialize(built), "ts"))
    guess = (F.col("value_mean_7") + F.coalesce("seen", "value_mean_7")) / 2
    metrics = regression_metrics(test.select("value", guess.alias("guess")), "value", "guess")
    sizes = train.agg(F.count(F.lit(1)).alias("n_train")).first()
    run = metrics.withColumn("n_train", F.lit(sizes["n_train"]))
    checks = check_rows(diagnose(run), [])
    return checks.select("level", "item", F.round("value", 6).alias("value"))


ITEMS_TEST_SQL = """
    i AS (SELECT l_orderkey * 16 + l_linenumber AS k, l_extendedprice AS y,
                 ('0x' || substr(md5((l_orderkey * 16 + l_linenumber) || '42'), 1, 8))::UBIGINT / 4294967296.0 < 0.2 AS in_test
          FROM lineitem)
    """
EVENTS_TEST_SQL = """
    h AS (SELECT event_id AS k, ts, value AS y, row_number() OVER (ORDER BY ts, event_id) AS n FROM events),
    c AS (SELECT ts AS cut FROM h WHERE n > 7 QUALIFY row_number() OVER (ORDER BY ts, k) = count(*) OVER () - ceil(count(*) OVER () * 0.2)),
    i AS (SELECT k, y, ts > (SELECT cut FROM c) AS in_test FROM h WHERE n > 7)
    """


STUMP_SQL = ", ".join(f"({i}, CAST({c} AS DOUBLE))" for i, c in enumerate(ITEM_FEATURES))


@query(
    f"""
    WITH i AS (SELECT l.*, l_orderkey * 16 + l_linenumber AS k, l_extendedprice AS y,
                      ('0x' || substr(md5((l_orderkey * 16 + l_linenumber) || '42'), 1, 8))::UBIGINT / 4294967296.0 < 0.2 AS in_test
               FROM lineitem l),
         m AS (SELECT avg(y) AS base, CAST(count(*) AS DOUBLE) AS rows FROM i WHERE NOT in_test),
         v AS (SELECT f, val, y - base AS rest, rows FROM i, m, LATERAL (VALUES {STUMP_SQL}) u(f, val) WHERE NOT in_test),
         g AS (SELECT f, val, sum(rest) AS s, count(*) AS n, any_value(rows) AS rows FROM v GROUP BY f, val),
         c AS (SELECT f, val, rows, sum(s) OVER low AS s, sum(n) OVER low AS n, sum(s) OVER (PARTITION BY f) AS s_all
               FROM g WINDOW low AS (PARTITION BY f ORDER BY val)),
         b AS (SELECT * FROM c WHERE n >= 1 AND rows - n >= 1
               ORDER BY s * s / (n + 1) + (s_all - s) * (s_all - s) / (rows - n + 1) DESC, f, val LIMIT 1)
    SELECT k AS row_id, round(base + CASE WHEN u.val <= b.val THEN s / (n + 1) ELSE (s_all - s) / (b.rows - n + 1) END, 4) AS prediction
    FROM i, m, b, LATERAL (VALUES {STUMP_SQL}) u(f, val) WHERE in_test AND u.f = b.f
    """
)
def boosted_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-order boosting of one round with one split, its bins as fine as the values."""
    rows = table(spark, sf_dir, "lineitem").withColumn("row_id", F.col("l_orderkey") * 16 + F.col("l_linenumber"))
    train, test = _parts(split.split_random(rows, "row_id"))
    whole = {"maxIter": 1, "maxDepth": 1, "stepSize": 1.0, "regLambda": 1.0, "maxBins": 255}
    plan = Plan("boosted_newton", "regression", "l_extendedprice", tuple(ITEM_FEATURES), "row_id", params=whole)
    return fit(plan, train).predict(test).select("row_id", F.round("prediction", 4).alias("prediction"))


def _families_sql(task: str) -> str:
    return ", ".join(f"('{f}')" for f in FAMILIES[task])


def _fit_checks(task: str, better: tuple[str, str]):
    """One row per family: predictions per test row, right labels, and what `better` tells.

    The rows with their features and split are made once for all families.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts, rows = [], TASK_ROWS[task](spark, sf_dir)
        plans = [TASK_PLANS[task](family, rows) for family in FAMILIES[task]]
        used = {c: None for p in plans for c in (p.key, p.target, *p.features, "part", *([p.time] if p.time else []))}
        train, test = _parts(materialize(rows.select(*used)))
        for plan in plans:
            preds, family = fit(plan, train).predict(test), plan.family
            key = preds.columns[0]
            parts.append(
                preds.agg(
                    F.lit(family).alias("family"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"),
                    F.round(F.sum(F.col("label").cast("double")), 2).alias("labels"),
                    F.count_if(F.col("prediction").isNull()).alias("n_missing"), F.expr(better[0]).alias(better[1]),
                )
            )
        return reduce(DataFrame.unionByName, parts)

    return run


INSIDE = ("bool_and(prediction IN (0, 1))", "inside")
# a mean predicts with the variance as its error; the prices hardly depend on the features
NEAR_MEAN = ("avg((label - prediction) * (label - prediction)) < 1.25 * var_pop(label)", "near_mean")
FINITE = ("bool_and(abs(prediction) < 1e9)", "finite")


@query(
    f"""
    WITH {DOCS_SQL}, t AS (SELECT count(*) AS n, CAST(sum(quality) AS DOUBLE) AS labels FROM d WHERE in_test)
    SELECT family, n AS n_rows, n AS n_keys, labels, CAST(0 AS BIGINT) AS n_missing, TRUE AS inside
    FROM t, (VALUES {_families_sql('classification')}) f(family)
    """
)
def fit_checks_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit_checks("classification", INSIDE)(spark, sf_dir)


@query(
    f"""
    WITH {ITEMS_TEST_SQL}, t AS (SELECT count(*) AS n, count(DISTINCT k) AS n_keys, round(sum(y), 2) AS labels FROM i WHERE in_test)
    SELECT family, n AS n_rows, n_keys, labels, CAST(0 AS BIGINT) AS n_missing, TRUE AS near_mean
    FROM t, (VALUES {_families_sql('regression')}) f(family)
    """
)
def fit_checks_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit_checks("regression", NEAR_MEAN)(spark, sf_dir)


@query(
    f"""
    WITH {EVENTS_TEST_SQL}, t AS (SELECT count(*) AS n, count(DISTINCT k) AS n_keys, round(sum(y), 2) AS labels FROM i WHERE in_test)
    SELECT family, n AS n_rows, n_keys, labels, CAST(0 AS BIGINT) AS n_missing, TRUE AS finite
    FROM t, (VALUES {_families_sql('timeseries')}) f(family)
    """
)
def fit_checks_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit_checks("timeseries", FINITE)(spark, sf_dir)


NB_TERM = " + ".join(f"ln(v_{c}) + (d.{c} - m_{c}) ** 2 / v_{c}" for c in DOC_FEATURES)
ORACLE["fit_naive_bayes"] = f"""
    WITH {DOCS_SQL}, tr AS (SELECT * FROM d WHERE NOT in_test),
         e AS (SELECT 1e-9 * greatest({', '.join(f'var_pop({c})' for c in DOC_FEATURES)}) AS eps FROM tr),
         g AS (SELECT quality, count(*) AS n, {', '.join(f'avg({c}) AS m_{c}, var_pop({c}) + any_value(eps) AS v_{c}' for c in DOC_FEATURES)}
               FROM tr, e GROUP BY quality),
         s AS (SELECT d.doc_id, d.quality AS label, g.quality AS c, ln(n) - 0.5 * ({NB_TERM}) AS score
               FROM d, g WHERE d.in_test)
    SELECT doc_id, any_value(label) AS label, arg_max(c, score) AS prediction FROM s GROUP BY doc_id
    """


@query("SELECT 'decision_tree' AS family, CAST(20 AS BIGINT) AS n_draws, CAST(20 AS BIGINT) AS n_settings, "
       "CAST(1 AS BIGINT) AS n_best, TRUE AS best_is_highest, TRUE AS in_range")  # fmt: skip
def tune_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The random search draws 20 different settings and marks the one with the highest score."""
    found = QUERIES["tune_decision_tree"](spark, sf_dir)
    return found.agg(
        F.lit("decision_tree").alias("family"), F.count(F.lit(1)).alias("n_draws"), F.count_distinct("params").alias("n_settings"),
        F.count_if("best").alias("n_best"), (F.max("score") == F.max(F.when(F.col("best"), F.col("score")))).alias("best_is_highest"),
        F.bool_and(F.col("score").between(0, 1)).alias("in_range"),
    )


@query(
    f"SELECT unnest({DOC_FEATURES}) AS feature, 1.0::DOUBLE AS total, TRUE AS not_negative"
)
def importance_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importances name every feature, are not negative and sum to one."""
    every = Window.partitionBy()
    total = F.round(F.sum("importance").over(every), 9)
    return QUERIES["feature_importance"](spark, sf_dir).select("feature", total.alias("total"), (F.col("importance") >= 0).alias("not_negative"))


@query(
    "SELECT * FROM (VALUES "
    + ", ".join(f"({i + 1}, '{f}', TRUE)" for i, f in enumerate(CANDIDATES["classification"]))
    + ") t(rank, family, in_range)"
)
def candidate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three candidates of different families, each with a share of right answers."""
    plans = QUERIES["candidate_plans"](spark, sf_dir)
    return plans.select("rank", "family", F.col("accuracy").between(0, 1).alias("in_range"))


@query(
    f"""
    WITH {DOCS_SQL}, c AS (SELECT toxic, count(*) AS n FROM d WHERE NOT in_test GROUP BY 1), m AS (SELECT max(n) AS most FROM c)
    SELECT toxic, most - n AS n_synthetic, least(n, most - n) AS n_origins, TRUE AS in_bounds, CAST(1 AS BIGINT) AS spread FROM c, m WHERE n < most
    """
)
def smote_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic rows per class, their origins, and that they lie between rows of their class.

    Every origin is used equally often, give or take one.
    """
    train, _ = _parts(document_features(spark, sf_dir))
    made = smote(train, DOC_FEATURES, "toxic", "doc_id").filter("synthetic")
    limits = train.groupBy("toxic").agg(
        *[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in DOC_FEATURES for n, f in (("low", F.min), ("high", F.max))]
    )
    inside = reduce(
        lambda a, b: a & b, [F.col(c).between(F.col(f"low_{c}") - 1e-9, F.col(f"high_{c}") + 1e-9) for c in DOC_FEATURES]
    )
    origins = train.select(F.col("doc_id").alias("origin"), F.lit(True).alias("known"))
    rows = made.join(limits, "toxic").join(origins, "origin", "left").withColumn("ok", inside & F.col("known"))
    per = rows.groupBy("toxic", "origin").agg(F.count(F.lit(1)).alias("n"), F.bool_and("ok").alias("ok"))
    return per.groupBy("toxic").agg(
        F.sum("n").alias("n_synthetic"), F.count(F.lit(1)).alias("n_origins"), F.bool_and("ok").alias("in_bounds"),
        F.greatest(F.max("n") - F.min("n"), F.lit(1)).cast("bigint").alias("spread"),
    )


@query("SELECT CAST(1 AS INTEGER) AS first_round, 'logistic_regression' AS first_family, TRUE AS gapless, TRUE AS at_most_three, "
       "TRUE AS tuned, TRUE AS best_is_highest")  # fmt: skip
def improve_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds follow each other, the first is the plan's family, each was tuned, and the best has the highest score."""
    train, test = _parts(document_features(spark, sf_dir))
    plan = Plan("logistic_regression", "classification", "toxic", tuple(DOC_FEATURES), "doc_id")
    runs = materialize(improve_plan(plan, train, test))
    best = best_of(runs).first()  # one session, so one row
    return runs.agg(
        F.min("round").alias("first_round"), F.min_by("family", "round").alias("first_family"),
        (F.max("round") == F.count(F.lit(1))).alias("gapless"), (F.max("round") <= 3).alias("at_most_three"),
        F.bool_and((F.size("best_params") > 0) & F.col("cv_score").between(0, 1)).alias("tuned"),
        (F.max("score") == F.lit(best["score"])).alias("best_is_highest"),
    )
