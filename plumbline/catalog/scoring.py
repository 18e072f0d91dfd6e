"""Queries on metrics, diagnosis, selection and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.registry import query, table
from plumbline.operators import diagnose as diag
from plumbline.operators import leaderboard as board
from plumbline.operators import skew
from plumbline.operators import usage as use
from plumbline.operators.profile import pearson
from plumbline.operators.metrics import classification_metrics, regression_metrics

LABEL_SQL = """
    p AS (SELECT l.quality AS label, CASE WHEN d.n_chars > 400 THEN 1 ELSE 0 END AS prediction
          FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
    """


def _f1_sql(source: str, by: str = "") -> str:
    """Accuracy and weighted F1 per group from rows (by, label, prediction)."""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
        SELECT {keys}sum(tp) / sum(support) AS accuracy,
               sum(CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) END * support)
                   / sum(support) AS f1,
               CAST(sum(support) AS BIGINT) AS n_test
        FROM (SELECT {keys}c, count(*) FILTER (WHERE role = 'y') AS support,
                     count(*) FILTER (WHERE role = 'p') AS predicted,
                     count(*) FILTER (WHERE role = 'y' AND hit) AS tp
              FROM (SELECT {keys}label AS c, 'y' AS role, label = prediction AS hit FROM {source}
                    UNION ALL
                    SELECT {keys}prediction, 'p', label = prediction FROM {source})
              GROUP BY {keys}c)
        {group}
        """


@query(
    f"""
    WITH {LABEL_SQL}
    SELECT round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, n_test FROM ({_f1_sql('p')})
    """
)
def clf_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    guess = F.when(F.col("n_chars") > 400, 1).otherwise(0).alias("prediction")
    preds = labels.join(docs, "doc_id").select(F.col("quality").alias("label"), guess)
    found = classification_metrics(preds)
    return found.withColumns({c: F.round(c, 6) for c in ("accuracy", "f1")})


@query(
    """
    WITH p AS (SELECT l_extendedprice AS y,
                      avg(l_extendedprice) OVER (PARTITION BY l_quantity) AS g FROM lineitem)
    SELECT round(sqrt(avg((y - g) ** 2)), 4) AS rmse, round(avg(abs(y - g)), 4) AS mae,
           round(1 - avg((y - g) ** 2) / var_pop(y), 6) AS r2, count(*) AS n_test
    FROM p
    """
)
def reg_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    means = items.groupBy("l_quantity").agg(F.avg("l_extendedprice").alias("guess"))
    preds = items.join(skew.broadcast_if_small(means), "l_quantity")
    found = regression_metrics(preds, "l_extendedprice", "guess")
    return found.select(
        F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"),
        F.round("r2", 6).alias("r2"), "n_test",
    )


# Runs made from the tables. Classification: one session per user and one per event type,
# three rounds guessing from the value whether it is at least 40. Regression: one session
# per supplier, three rounds guessing prices from quantities.
GUESSES = {1: "value >= 15", 2: "value >= 30", 3: "value >= 40 AND event_type <> 'error'"}
RATES = {1: 500, 2: 1100, 3: 1500}

CLF_RUNS_SQL = (
    "e AS (SELECT 'user ' || user_id AS session_id, * FROM events UNION ALL "
    "SELECT 'type ' || event_type, * FROM events), "
    "g AS ("
    + " UNION ALL ".join(
        f"SELECT session_id, {r} AS round, CASE WHEN value >= 40 THEN 'hi' ELSE 'lo' END AS label, "
        f"CASE WHEN {sql} THEN 'hi' ELSE 'lo' END AS prediction FROM e"
        for r, sql in GUESSES.items()
    )
    + f"), m AS ({_f1_sql('g', 'session_id, round')}), "
    "d AS (SELECT session_id, count(*) FILTER (WHERE value >= 40) AS hi, "
    "count(*) FILTER (WHERE value < 40) AS lo, "
    "sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS f_click, "
    "sum(CASE WHEN event_type <> 'click' THEN value ELSE 0 END) AS f_rest, "
    "corr(value, user_id) AS c1, corr(value, value * value) AS c2, corr(value, sqrt(value)) AS c3, "
    "corr(value * value, value * value * value) AS c4, corr(value, value * value * value) AS c5, "
    "max(value) AS top FROM e GROUP BY 1), "
    "clf AS (SELECT m.session_id, m.round, 'classification' AS task, m.accuracy, m.f1, "
    "NULL::DOUBLE AS r2, NULL::DOUBLE AS rmse, NULL::DOUBLE AS mae, "
    "(SELECT count(*) FROM e x WHERE x.session_id = m.session_id) AS n_train, m.n_test, hi, lo, "
    "f_click, f_rest, c1, c2, c3, c4, c5, m.round = 3 AS smote, m.round >= 2 AS balanced, "
    "NOT (m.round = 2 AND top > 200) AS ok FROM m JOIN d ON m.session_id = d.session_id)"
)
REG_RUNS_SQL = (
    "h AS ("
    + " UNION ALL ".join(
        f"SELECT 'supplier ' || l_suppkey AS session_id, {r} AS round, l_extendedprice AS y, "
        f"l_quantity * {rate} AS g, l_tax FROM lineitem"
        for r, rate in RATES.items()
    )
    + "), reg AS (SELECT session_id, round, 'regression' AS task, NULL::DOUBLE AS accuracy, "
    "NULL::DOUBLE AS f1, 1 - avg((y - g) ** 2) / var_pop(y) AS r2, sqrt(avg((y - g) ** 2)) AS rmse, "
    "avg(abs(y - g)) AS mae, count(*) AS n_train, count(*) AS n_test, NULL::BIGINT AS hi, "
    "NULL::BIGINT AS lo, NULL::DOUBLE AS f_click, NULL::DOUBLE AS f_rest, NULL::DOUBLE AS c1, "
    "NULL::DOUBLE AS c2, NULL::DOUBLE AS c3, NULL::DOUBLE AS c4, NULL::DOUBLE AS c5, "
    "FALSE AS smote, FALSE AS balanced, "
    "count(*) FILTER (WHERE l_tax >= 0.04) * (round + 1) % 4 <> 0 AS ok FROM h GROUP BY 1, 2)"
)
CHECKS_SQL = f"""
    {CLF_RUNS_SQL}, {REG_RUNS_SQL},
    runs AS (SELECT *, n_train + n_test AS n,
                    greatest(hi, lo) / greatest(least(hi, lo), 1) AS ratio,
                    greatest(f_click, f_rest) / (f_click + f_rest) AS share
             FROM (SELECT * FROM clf UNION ALL BY NAME SELECT * FROM reg)),
    pairs AS (SELECT session_id, round, list(p ORDER BY abs(p.corr) DESC, p.a, p.b)
                     FILTER (WHERE abs(p.corr) > 0.9 AND NOT isnan(p.corr)) AS ps
              FROM (SELECT session_id, round, unnest([
                        {{'a': 'value', 'b': 'user', 'corr': c1}},
                        {{'a': 'value', 'b': 'square', 'corr': c2}},
                        {{'a': 'value', 'b': 'root', 'corr': c3}},
                        {{'a': 'square', 'b': 'cube', 'corr': c4}},
                        {{'a': 'value', 'b': 'cube', 'corr': c5}}]) AS p
                    FROM runs WHERE task = 'classification') GROUP BY 1, 2),
    checks AS (
        SELECT session_id, round, '샘플 수' AS item,
               CASE WHEN n < 100 THEN 'critical' WHEN n < 500 THEN 'warning' ELSE 'ok' END AS level,
               CAST(n AS DOUBLE) AS value, NULL::VARCHAR AS detail FROM runs
        UNION ALL
        SELECT session_id, round,
               CASE WHEN accuracy > 0.995 THEN '정확도 과도' WHEN accuracy < 0.55 THEN '정확도 부족'
                    ELSE '정확도' END,
               CASE WHEN accuracy > 0.995 OR accuracy < 0.55 THEN 'critical'
                    WHEN accuracy < 0.70 THEN 'warning' ELSE 'ok' END, accuracy, NULL
        FROM runs WHERE accuracy IS NOT NULL
        UNION ALL
        SELECT session_id, round, '클래스 불균형',
               CASE WHEN ratio > 10 THEN CASE WHEN smote THEN 'ok' WHEN balanced THEN 'warning'
                                              ELSE 'critical' END
                    ELSE CASE WHEN smote OR balanced THEN 'ok' ELSE 'warning' END END, ratio, NULL
        FROM runs WHERE ratio > 3
        UNION ALL
        SELECT session_id, round,
               CASE WHEN r2 > 0.995 THEN 'R² 과도' WHEN r2 < 0 THEN 'R² 음수'
                    WHEN r2 < 0.3 THEN '설명력 부족' ELSE '설명력' END,
               CASE WHEN r2 > 0.995 OR r2 < 0.3 THEN 'critical' WHEN r2 < 0.6 THEN 'warning'
                    ELSE 'ok' END, r2, NULL FROM runs WHERE r2 IS NOT NULL
        UNION ALL
        SELECT session_id, round, '다중공선성', 'warning', CAST(len(ps) AS DOUBLE),
               array_to_string(list_transform(ps[1:3],
                   lambda p: printf('%s~%s(%.2f)', p.a, p.b, p.corr)), ', ')
               || CASE WHEN len(ps) > 3 THEN ' 외 ' || (len(ps) - 3) || '쌍' ELSE '' END
        FROM pairs WHERE len(ps) > 0
        UNION ALL
        SELECT session_id, round, '피처 쏠림', 'warning', share,
               CASE WHEN f_click > f_rest THEN 'click' ELSE 'rest' END
        FROM runs WHERE share > 0.85),
    verdicts AS (SELECT session_id, round,
                        CASE WHEN bool_or(level = 'critical') THEN '신뢰 어려움'
                             WHEN bool_or(level = 'warning') THEN '주의 필요'
                             ELSE '신뢰 가능' END AS verdict
                 FROM checks GROUP BY 1, 2),
    scored AS (SELECT r.*, v.verdict,
                      CASE WHEN task = 'classification' THEN coalesce(f1, accuracy) ELSE r2 END AS score
               FROM runs r JOIN verdicts v ON r.session_id = v.session_id AND r.round = v.round)
    """
STOP_SQL = """
    after AS (SELECT s.session_id, s.round, s.ok, s.verdict,
                     coalesce(bool_or(p.ok), FALSE) AS succeeded
              FROM scored s LEFT JOIN scored p ON p.session_id = s.session_id AND p.round < s.round
              GROUP BY ALL),
    stops AS (SELECT session_id,
                     least(min(round) FILTER (WHERE ok AND verdict = '신뢰 가능'),
                           min(round) FILTER (WHERE NOT ok AND succeeded), max(round)) AS stop_round
              FROM after GROUP BY 1)
    """


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undiagnosed run rows derived from events and lineitem."""
    return _clf_runs(spark, sf_dir).unionByName(_reg_runs(spark, sf_dir), allowMissingColumns=True)


def _clf_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    user = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    kind = F.concat(F.lit("type "), F.col("event_type"))
    e = events.withColumn("session_id", F.explode(F.array(user, kind)))
    rounds = F.array(
        *[
            F.struct(
                F.lit(r).alias("round"),
                F.when(F.expr(sql), "hi").otherwise("lo").alias("prediction"),
            )
            for r, sql in GUESSES.items()
        ]
    )
    label = F.when(F.col("value") >= 40, "hi").otherwise("lo").alias("label")
    preds = e.select("session_id", label, F.inline(rounds))
    metrics = classification_metrics(preds, by=["session_id", "round"])
    square, root = F.col("value") * F.col("value"), F.sqrt("value")
    pairs = [
        ("value", "user", pearson(F.col("value"), F.col("user_id"))),
        ("value", "square", pearson(F.col("value"), square)),
        ("value", "root", pearson(F.col("value"), root)),
        ("square", "cube", pearson(square, square * F.col("value"))),
        ("value", "cube", pearson(F.col("value"), square * F.col("value"))),
    ]
    clicks = F.when(F.col("event_type") == "click", F.col("value")).otherwise(0.0)
    rest = F.when(F.col("event_type") != "click", F.col("value")).otherwise(0.0)
    hi, lo = F.count_if(F.col("value") >= 40), F.count_if(F.col("value") < 40)
    facts = e.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_train"),
        F.map_from_arrays(F.array(F.lit("hi"), F.lit("lo")), F.array(hi, lo)).alias("class_distribution"),
        F.map_from_arrays(
            F.array(F.lit("click"), F.lit("rest")), F.array(F.sum(clicks), F.sum(rest))
        ).alias("feature_importance"),
        F.array(
            *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c.alias("corr")) for a, b, c in pairs]
        ).alias("all_pairs"),
        F.max("value").alias("top"),
    )
    strong = F.filter("all_pairs", lambda p: F.abs(p["corr"]) > 0.9)
    ranked = F.transform(
        F.array_sort(
            F.transform(strong, lambda p: F.struct((-F.abs(p["corr"])).alias("o"), p["a"].alias("a"), p["b"].alias("b"), p["corr"].alias("corr")))
        ),
        lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), p["corr"].alias("corr")),
    )
    return metrics.join(facts, "session_id").select(
        "session_id", "round", F.lit("classification").alias("task"), "accuracy", "f1", "n_train",
        "n_test", "class_distribution", "feature_importance",
        ranked.alias("high_correlation_pairs"),
        (F.col("round") == 3).alias("smote"), (F.col("round") >= 2).alias("balanced"),
        (~((F.col("round") == 2) & (F.col("top") > 200))).alias("ok"),
    )


def _reg_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_extendedprice", "l_quantity", "l_tax"
    )
    rounds = F.array(
        *[
            F.struct(F.lit(r).alias("round"), (F.col("l_quantity") * rate).alias("guess"))
            for r, rate in RATES.items()
        ]
    )
    session = F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("session_id")
    preds = items.select(session, "l_extendedprice", "l_tax", F.inline(rounds))
    by = ["session_id", "round"]
    metrics = regression_metrics(preds, "l_extendedprice", "guess", by)
    taxed = preds.groupBy(*by).agg(F.count_if(F.col("l_tax") >= 0.04).alias("taxed"))
    return metrics.join(taxed, by).select(
        *by, F.lit("regression").alias("task"), "rmse", "mae", "r2",
        F.col("n_test").alias("n_train"), "n_test",
        F.lit(False).alias("smote"), F.lit(False).alias("balanced"),
        (F.col("taxed") * (F.col("round") + 1) % 4 != 0).alias("ok"),
    )


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.run_score(diag.diagnose(runs(spark, sf_dir)))


RUN = ["session_id", "round"]


@query(f"WITH {CHECKS_SQL} SELECT session_id, round, item, level, round(value, 6) AS value, detail FROM checks")
def diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = diag.check_rows(diag.diagnose(runs(spark, sf_dir)), RUN)
    return checks.withColumn("value", F.round("value", 6))


@query(f"WITH {CHECKS_SQL} SELECT session_id, round, verdict FROM verdicts")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diag.diagnose(runs(spark, sf_dir)).select(*RUN, "verdict")


@query(
    f"""WITH {CHECKS_SQL} SELECT session_id, round, item, level, round(value, 6) AS value, detail
    FROM checks WHERE level IN ('warning', 'critical')"""
)
def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = diag.feedback(diag.diagnose(runs(spark, sf_dir)), RUN)
    return notes.withColumn("value", F.round("value", 6))


@query(f"WITH {CHECKS_SQL} SELECT session_id, round, task, round(score, 6) AS score FROM scored")
def run_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = board.run_score(runs(spark, sf_dir))
    return scored.select(*RUN, "task", F.round("score", 6).alias("score"))


@query(f"WITH {CHECKS_SQL}, {STOP_SQL} SELECT session_id, stop_round FROM stops")
def stop_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.stop_round(_scored(spark, sf_dir), ["session_id"])


@query(
    f"""
    WITH {CHECKS_SQL}, {STOP_SQL},
         r AS (SELECT s.*, stop_round, row_number() OVER (PARTITION BY s.session_id
                      ORDER BY score DESC NULLS LAST,
                               CASE WHEN score IS NULL THEN -round ELSE round END) AS place
               FROM scored s JOIN stops t ON s.session_id = t.session_id
               WHERE ok AND round <= stop_round)
    SELECT session_id, round, stop_round, verdict, round(score, 6) AS score FROM r WHERE place = 1
    """
)
def best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = board.best_run(_scored(spark, sf_dir), ["session_id"])
    return best.select(*RUN, "stop_round", "verdict", F.round("score", 6).alias("score"))


METRICS = ("accuracy", "f1", "rmse", "mae", "r2", "n_train", "n_test")


@query(
    f"WITH {CHECKS_SQL} "
    + " UNION ALL ".join(
        f"SELECT session_id, round, '{m}' AS metric, round(CAST({m} AS DOUBLE), 4) AS value FROM runs "
        f"WHERE {m} IS NOT NULL"
        for m in METRICS
    )
)
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.report(runs(spark, sf_dir), RUN)


IMPORTANCE_SQL = "i AS (SELECT p_brand AS feature, sum(p_size) / (SELECT sum(p_size) FROM part) AS importance FROM part GROUP BY 1)"


@query(
    f"""WITH {IMPORTANCE_SQL} SELECT feature, round(importance, 6) AS importance FROM i
    ORDER BY i.importance DESC, feature LIMIT 15"""
)
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    sizes = part.groupBy(F.col("p_brand").alias("feature")).agg(F.sum("p_size").alias("s"))
    total = part.agg(F.sum("p_size")).first()[0]
    shares = sizes.select("feature", (F.col("s") / total).alias("importance"))
    return board.top_features(shares, 15).withColumn("importance", F.round("importance", 6))


@query(
    """
    WITH i AS (SELECT p_type, p_brand AS feature, sum(p_size) AS importance FROM part GROUP BY 1, 2),
         r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY importance DESC, feature) AS n
               FROM i)
    SELECT p_type, feature, CAST(importance AS BIGINT) AS importance FROM r WHERE n <= 10
    """
)
def top_features_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").groupBy("p_type", F.col("p_brand").alias("feature"))
    return board.top_features(sizes.agg(F.sum("p_size").alias("importance")), 10, by=["p_type"])


# A usage log from conversations: characters as tokens, the role as the model; the prices
# are per million tokens, and the last role has none.
PRICES = {"user": (3.0, 15.0), "assistant": (5.0, 25.0)}
USAGE_SQL = """
    u AS (SELECT conv_id, turn, role AS model, length(text) AS input_tokens,
                 length(replace(text, ' ', '')) AS output_tokens FROM conversations),
    c AS (SELECT *, CASE model
                    WHEN 'user' THEN input_tokens / 1000000 * 3.0 + output_tokens / 1000000 * 15.0
                    WHEN 'assistant' THEN input_tokens / 1000000 * 5.0 + output_tokens / 1000000 * 25.0
                    ELSE 0.0 END AS cost_usd FROM u)
    """


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("role").alias("model"),
        F.length("text").cast("bigint").alias("input_tokens"),
        F.length(F.replace("text", F.lit(" "), F.lit(""))).cast("bigint").alias("output_tokens"),
    )


@query(
    f"WITH {USAGE_SQL} SELECT conv_id, turn, model, input_tokens, output_tokens, "
    "round(CAST(cost_usd AS DOUBLE), 8) AS cost_usd FROM c"
)
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    costed = use.usage_cost(_usage(spark, sf_dir), PRICES)
    return costed.withColumn("cost_usd", F.round("cost_usd", 8))


@query(
    f"""
    WITH {USAGE_SQL}
    SELECT conv_id, model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
           CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
           round(CAST(sum(cost_usd) AS DOUBLE), 8) AS cost_usd
    FROM c GROUP BY 1, 2
    """
)
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    costed = use.usage_cost(_usage(spark, sf_dir), PRICES)
    rolled = use.usage_rollup(costed, ["conv_id", "model"])
    return rolled.withColumn("cost_usd", F.round("cost_usd", 8))


SNAPSHOT_SQL = """
    s AS (SELECT user_id, event_id, round(value * 100)::BIGINT AS input_tokens FROM events)
    """


@query(
    f"""
    WITH {SNAPSHOT_SQL}
    SELECT user_id, event_id, input_tokens,
           input_tokens - coalesce(lag(input_tokens) OVER (PARTITION BY user_id ORDER BY event_id), 0)
               AS input_tokens_delta
    FROM s
    """
)
def usage_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.round(F.col("value") * 100).cast("bigint").alias("input_tokens")
    snapshots = table(spark, sf_dir, "events").select("user_id", "event_id", tokens)
    return use.usage_delta(snapshots, ["user_id"], "event_id", ["input_tokens"])


REQUEST_SQL = """
    r AS (SELECT conv_id, turn, sha256(length(role) || ':' || role || '3:0.2' ||
                        length(text) || ':' || text) AS request_key,
                 conv_id * 1000 + turn AS call, length(text) AS answer FROM conversations)
    """


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", use.request_key("role", F.lit("0.2"), "text").alias("request_key"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("call"),
        F.length("text").cast("bigint").alias("answer"),
    )


@query(
    f"""
    WITH {REQUEST_SQL}
    SELECT request_key, min(call) AS first_call, arg_min(answer, call) AS answer,
           count(*) AS calls, count(*) - 1 AS hits
    FROM r GROUP BY 1
    """
)
def request_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return use.dedupe_requests(_requests(spark, sf_dir), "request_key", "call", "answer")


@query(
    f"""
    WITH {REQUEST_SQL}
    SELECT conv_id, turn, request_key, call,
           first_value(answer) OVER (PARTITION BY request_key ORDER BY call) AS answer,
           call > min(call) OVER (PARTITION BY request_key) AS reused
    FROM r
    """
)
def request_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return use.reuse_answers(_requests(spark, sf_dir), "request_key", "call", "answer")
