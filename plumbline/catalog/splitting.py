"""Queries on splits and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.registry import query, table
from plumbline.functions.hashing import fold_of
from plumbline.operators import audit, split


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_random(table(spark, sf_dir, "orders"), "o_orderkey")


UNIT_SQL = "('0x' || substr(md5(o_orderkey || '{seed}'), 1, 8))::UBIGINT / 4294967296.0"
PART_SQL = f"CASE WHEN {UNIT_SQL.format(seed=42)} < 0.2 THEN 'test' ELSE 'train' END"
ORDERS_SQL = f"o AS (SELECT *, {PART_SQL} AS part FROM orders)"
PARTS_SQL = f"""WITH {ORDERS_SQL}, train AS (SELECT * FROM o WHERE part = 'train'),
    test AS (SELECT * FROM o WHERE part = 'test')"""


def _finding_sql(audit_name: str, detail: str, count: str) -> str:
    return f"""SELECT '{audit_name}' AS audit, CASE WHEN n > 0 THEN 'critical' ELSE 'ok' END AS level,
        '{detail}' AS detail, CAST(n AS BIGINT) AS n FROM ({count})"""


@query(f"SELECT o_orderkey, {PART_SQL} AS part FROM orders")
def split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", "part")


CUT_SQL = """
    c AS (SELECT max(t) FILTER (WHERE rn <= n - ceil(n * 0.2)) AS cut
          FROM (SELECT {t} AS t, row_number() OVER (ORDER BY {t}) AS rn,
                       count(*) OVER () AS n FROM {name}))
    """


@query(
    f"""
    WITH {CUT_SQL.format(t='ts', name='events')}
    SELECT event_id, CASE WHEN ts > cut THEN 'test' ELSE 'train' END AS part FROM events, c
    """
)
def split_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_time(table(spark, sf_dir, "events"), "ts").select("event_id", "part")


@query(
    f"""
    WITH {CUT_SQL.format(t='o_orderdate', name='orders')}
    SELECT o_orderkey, CASE WHEN o_orderdate > cut THEN 'test' ELSE 'train' END AS part
    FROM orders, c
    """
)
def split_time_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many orders share a date; the whole day of the cut stays in training."""
    parts = split.split_time(table(spark, sf_dir, "orders"), "o_orderdate")
    return parts.select("o_orderkey", "part")


def _parts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("part = 'train'"), df.filter("part = 'test'")


LEAK_COUNT = """SELECT count(*) AS n FROM test2 WHERE o_orderkey IN (SELECT o_orderkey FROM train)"""
PLANTED_SQL = f"""{PARTS_SQL}, test2 AS (SELECT o_orderkey FROM test UNION ALL
    SELECT o_orderkey FROM train WHERE o_orderstatus = 'P')"""


def _planted(train: DataFrame, test: DataFrame) -> DataFrame:
    return test.unionByName(train.filter("o_orderstatus = 'P'"))


@query(
    f"""
    {PLANTED_SQL}, s AS (SELECT o_orderkey AS origin FROM o WHERE o_orderpriority = '1-URGENT')
    {_finding_sql('leakage', 'test rows in train', LEAK_COUNT)}
    UNION ALL
    {_finding_sql('leakage', 'synthetic rows not derived from train',
                  "SELECT count(*) AS n FROM s WHERE origin NOT IN (SELECT o_orderkey FROM train)")}
    """
)
def audit_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some training orders are put into the test part, and copies of any order into training."""
    orders = _orders(spark, sf_dir)
    train, test = _parts(orders)
    made = orders.filter("o_orderpriority = '1-URGENT'").select(
        (-F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_orderkey").alias("origin")
    )
    real = train.select("o_orderkey", F.lit(None).cast("bigint").alias("origin"))
    return audit.audit_leakage(
        real.unionByName(made), _planted(train, test), "o_orderkey", origin="origin"
    )


@query(
    f"""{PARTS_SQL}
    {_finding_sql('cv_integrity', 'fold rows outside train',
                  "SELECT count(*) AS n FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM train)")}
    """
)
def audit_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds drawn from all orders instead of the training part."""
    orders = _orders(spark, sf_dir)
    folds = orders.select("o_orderkey", fold_of("o_orderkey").alias("fold"))
    return audit.audit_cv(folds, _parts(orders)[0], "o_orderkey")


@query(
    f"""{PARTS_SQL}
    {_finding_sql('oversample_order', 'synthetic rows in test',
                  "SELECT count(*) AS n FROM test WHERE o_orderstatus = 'P'")}
    """
)
def audit_oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = _parts(_orders(spark, sf_dir))[1]
    return audit.audit_oversample(test.withColumn("made", F.col("o_orderstatus") == "P"), "made")


@query(
    f"""{PARTS_SQL}
    {_finding_sql('evaluation', 'predictions on train only', 'SELECT count(*) AS n FROM train')}
    UNION ALL {_finding_sql('evaluation', 'predictions on train only', 'SELECT 0 AS n')}
    """
)
def audit_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Once with predictions for training orders only, once for all orders."""
    orders = _orders(spark, sf_dir)
    train, test = _parts(orders)
    only_train = audit.audit_eval(train.select("o_orderkey"), train, test, "o_orderkey")
    everything = audit.audit_eval(orders.select("o_orderkey"), train, test, "o_orderkey")
    return only_train.unionByName(everything)


@query(
    f"""
    WITH {CUT_SQL.format(t='ts', name='events')},
         h AS (SELECT ts, ('0x' || substr(md5(event_id || '42'), 1, 8))::UBIGINT / 4294967296.0 < 0.2
                      AS in_test FROM events)
    {_finding_sql('time_split', 'train rows after first test row', 'SELECT 0 AS n')}
    UNION ALL
    {_finding_sql('time_split', 'train rows after first test row',
                  "SELECT count(*) AS n FROM h WHERE NOT in_test AND "
                  "ts > (SELECT min(ts) FROM h WHERE in_test)")}
    """
)
def audit_time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Once on a chronological split, once on a shuffled one."""
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    good = _parts(split.split_time(events, "ts"))
    shuffled = _parts(split.split_random(events, "event_id"))
    return audit.audit_time_split(*good, "ts").unionByName(audit.audit_time_split(*shuffled, "ts"))


@query(
    f"""WITH {ORDERS_SQL}
    {_finding_sql('reproducibility', 'rows split differently', 'SELECT 0 AS n')}
    UNION ALL
    {_finding_sql('reproducibility', 'rows split differently',
                  f"SELECT count(*) AS n FROM o WHERE ({UNIT_SQL.format(seed=7)} < 0.2) <> (part = 'test')")}
    """
)
def audit_repro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Once against the same seed, once against a split made with another one."""
    orders = table(spark, sf_dir, "orders")
    same = audit.audit_repro(orders, _orders(spark, sf_dir), "o_orderkey")
    other = split.split_random(orders, "o_orderkey", seed=7)
    return same.unionByName(audit.audit_repro(orders, other, "o_orderkey"))


@query(
    f"""{PLANTED_SQL}
    {_finding_sql('leakage', 'test rows in train', LEAK_COUNT)}
    UNION ALL {_finding_sql('cv_integrity', 'fold rows outside train', 'SELECT 0 AS n')}
    UNION ALL {_finding_sql('oversample_order', 'synthetic rows in test', 'SELECT 0 AS n')}
    UNION ALL {_finding_sql('evaluation', 'predictions on train only', 'SELECT 0 AS n')}
    UNION ALL {_finding_sql('reproducibility', 'rows split differently',
                            "SELECT count(*) AS n FROM train WHERE o_orderstatus = 'P'")}
    """
)
def run_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All audits on a classification split into which leaked rows are planted."""
    orders = _orders(spark, sf_dir).withColumn("made", F.lit(False))
    train, test = _parts(orders)
    return audit.run_audits(
        orders, "o_orderkey", train, _planted(train, test),
        folds=train.select("o_orderkey", fold_of("o_orderkey").alias("fold")),
        preds=test.select("o_orderkey"), synthetic="made",
    )
