"""Queries on feature preparation and time-series features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.combining import LABELLED_SQL, labelled_documents
from plumbline.catalog.profiling import PRICED_COLUMNS, PRICED_SQL, priced_items
from plumbline.catalog.registry import query, table
from plumbline.operators import prepare as prep
from plumbline.operators import series
from plumbline.operators.profile import high_corr_pairs


@query(
    """
    SELECT p_partkey, TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE) AS brand_number,
           TRY_CAST(p_type AS DOUBLE) AS type_number, CAST(p_size AS DOUBLE) AS size
    FROM part
    """
)
def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("brand_number"),
        F.col("p_type").alias("type_number"),
        F.col("p_size").alias("size"),
    )
    return prep.coerce_numeric(part, ["brand_number", "type_number", "size"])


@query(
    """
    SELECT l_orderkey, l_linenumber, l_shipdate,
           dense_rank() OVER (ORDER BY l_returnflag) - 1 AS l_returnflag, l_linestatus
    FROM lineitem
    """
)
def encode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_linestatus"
    )
    return prep.encode_labels(items, target="l_linestatus")


@query(
    """
    SELECT event_id, user_id, dense_rank() OVER (ORDER BY event_type) - 1 AS event_type, value
    FROM events
    """
)
def encode_labels_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text column with many values is dropped."""
    events = table(spark, sf_dir, "events")
    wide = events.withColumn("note", F.concat("props", F.col("event_id").cast("string")))
    return prep.encode_labels(wide.select("event_id", "user_id", "event_type", "value", "note"))


@query(
    f"""
    SELECT * FROM ({LABELLED_SQL})
    WHERE doc_id IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL
      AND n_chars IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL
    """
)
def drop_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.drop_incomplete(labelled_documents(spark, sf_dir))


@query(
    """
    SELECT l_orderkey, l_linenumber,
           round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6)
               AS l_quantity,
           round((l_extendedprice - avg(l_extendedprice) OVER ())
                 / stddev_pop(l_extendedprice) OVER (), 6) AS l_extendedprice
    FROM lineitem
    """
)
def scale_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["l_quantity", "l_extendedprice"]
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *cols)
    return prep.scale(items, cols).withColumns({c: F.round(c, 6) for c in cols})


@query(
    """
    WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1)
    SELECT l.doc_id, l.quality, l.toxic,
           round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * c.n), 6) AS weight
    FROM labels l JOIN c ON l.quality = c.quality
    """
)
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = prep.class_weights(table(spark, sf_dir, "labels"), "quality")
    return weighted.withColumn("weight", F.round("weight", 6))


@query(
    f"""
    SELECT l_quantity, l_discount, l_tax, l_extendedprice, round(net, 6) AS net
    FROM ({PRICED_SQL})
    """
)
def drop_collinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = priced_items(spark, sf_dir)
    kept = prep.drop_collinear(items, high_corr_pairs(items, "l_extendedprice"))
    return kept.withColumn("net", F.round("net", 6))


@query(
    f"""
    WITH j AS ({LABELLED_SQL})
    SELECT doc_id, lang, source, n_chars,
           round(coalesce(CAST(quality AS DOUBLE), avg(quality) OVER ()), 6) AS quality,
           round(coalesce(CAST(toxic AS DOUBLE), avg(toxic) OVER ()), 6) AS toxic
    FROM j
    """
)
def impute_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["quality", "toxic"]
    filled = prep.impute(labelled_documents(spark, sf_dir), cols, "mean")
    return filled.withColumns({c: F.round(c, 6) for c in cols})


@query(
    """
    SELECT event_id,
           coalesce(CASE WHEN event_type <> 'error' THEN value END,
                    median(CASE WHEN event_type <> 'error' THEN value END) OVER ()) AS value
    FROM events
    """
)
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of error events count as missing."""
    known = F.when(F.col("event_type") != "error", F.col("value"))
    events = table(spark, sf_dir, "events").select("event_id", known.alias("value"))
    return prep.impute(events, ["value"], "median")


@query(
    """
    SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net,
           l_extendedprice / l_quantity AS unit_price, l_discount > 0.05 AS discounted
    FROM lineitem
    """
)
def derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = {
        "net": "l_extendedprice * (1 - l_discount)",
        "unit_price": "l_extendedprice / l_quantity",
        "discounted": "l_discount > 0.05D",
    }
    derived = prep.derive(table(spark, sf_dir, "lineitem"), features)
    return derived.select("l_orderkey", "l_linenumber", *features)


@query(
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
           l_discount, l_tax, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS l_returnflag,
           l_linestatus
    FROM lineitem
    """
)
def prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumn("__source", F.lit("items"))
    return prep.prepare(items, target="l_linestatus")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")


def _lag_sql(window: str) -> str:
    return ", ".join(f"lag(value, {k}) OVER ({window}) AS value_lag_{k}" for k in (1, 2, 3, 7))


def _roll_sql(window: str) -> str:
    parts = []
    for w in (3, 7):
        frame = f"OVER ({window} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        for name, f in (("mean", "avg"), ("std", "stddev_samp")):
            parts.append(
                f"CASE WHEN count(value) {frame} = {w} THEN round({f}(value) {frame}, 6) END "
                f"AS value_{name}_{w}"
            )
    return ", ".join(parts)


ROLLED = [f"value_{s}_{w}" for w in (3, 7) for s in ("mean", "std")]


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ROLLED})


BY_TIME = "ORDER BY ts, event_id"
BY_USER = "PARTITION BY user_id ORDER BY ts, event_id"


@query(f"SELECT event_id, ts, user_id, value, {_lag_sql(BY_TIME)} FROM events")
def ts_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.lags(_events(spark, sf_dir), "value", "ts", tiebreak=["event_id"])


@query(f"SELECT event_id, ts, user_id, value, {_lag_sql(BY_USER)} FROM events")
def ts_lags_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.lags(_events(spark, sf_dir), "value", "ts", by=["user_id"], tiebreak=["event_id"])


@query(f"SELECT event_id, ts, user_id, value, {_roll_sql(BY_TIME)} FROM events")
def ts_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.rolling(_events(spark, sf_dir), "value", "ts", tiebreak=["event_id"]))


@query(f"SELECT event_id, ts, user_id, value, {_roll_sql(BY_USER)} FROM events")
def ts_rolling_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = series.rolling(
        _events(spark, sf_dir), "value", "ts", by=["user_id"], tiebreak=["event_id"]
    )
    return _rounded(rolled)


@query(f"SELECT event_id, ts, user_id, value, {_roll_sql(BY_USER)} FROM events")
def ts_rolling_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed rolling with every user treated as too large for one task."""
    rolled = series.rolling(
        _events(spark, sf_dir), "value", "ts", by=["user_id"], tiebreak=["event_id"],
        chunk_rows=1000, hot_rows=1,
    )
    return _rounded(rolled)


def _calendar_sql(col: str) -> str:
    return f"""CAST(year({col}) AS INTEGER) AS year, CAST(month({col}) AS INTEGER) AS month,
        CAST(day({col}) AS INTEGER) AS day, CAST(isodow({col}) - 1 AS INTEGER) AS dayofweek"""


@query(
    f"SELECT o_orderkey AS id, {_calendar_sql('o_orderdate')} FROM orders "
    f"UNION ALL SELECT event_id, {_calendar_sql('ts')} FROM events"
)
def ts_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts")
    return series.calendar(orders, "o_orderdate").drop("o_orderdate").unionByName(
        series.calendar(events, "ts").drop("ts")
    )


@query(
    f"""
    WITH f AS (SELECT event_id, user_id, value, {_lag_sql(BY_TIME)}, {_roll_sql(BY_TIME)},
                      {_calendar_sql('ts')} FROM events)
    SELECT * FROM f WHERE value_lag_7 IS NOT NULL AND value_std_7 IS NOT NULL
    """
)
def ts_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        series.ts_features(_events(spark, sf_dir), "value", "ts", tiebreak=["event_id"])
    )
