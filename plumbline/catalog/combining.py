"""Queries on ingest and on combining tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.registry import query, table
from plumbline.operators.asof import asof_chain, asof_join
from plumbline.operators.combine import combine, concat_tables, join_tables
from plumbline.operators.durable import stage_path
from plumbline.sources.documents import cap_text
from plumbline.sources.files import read_folder, read_table, require_rows, write_prepared


DOCUMENT_ROWS = 10_000


def _new_folder(spark: SparkSession) -> str:
    return f"{stage_path(spark, 'files')}/table"


@query(
    """
    SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey,
           c_acctbal, c_mktsegment
    FROM customer
    """
)
def read_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _new_folder(spark) + ".csv"
    write_prepared(table(spark, sf_dir, "customer"), folder, "csv")
    return require_rows(read_table(spark, folder), "customer")


@query(
    """
    SELECT event_id, CASE WHEN event_type = 'view' THEN value END AS value,
           CASE WHEN event_type <> 'view' THEN user_id END AS user_id,
           strftime(ts, '%m.%d.%Y') AS "DATE", strftime(ts, '%H:%M:%S') AS "TIME",
           date_trunc('second', ts) AS event_time
    FROM events
    """
)
def folder_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumns(
        {"DATE": F.date_format("ts", "MM.dd.yyyy"), "TIME": F.date_format("ts", "HH:mm:ss")}
    )
    folder = _new_folder(spark)
    views = events.filter("event_type = 'view'").select("DATE", "TIME", "event_id", "value")
    others = events.filter("event_type <> 'view'").select("user_id", "event_id", "TIME", "DATE")
    views.write.csv(folder, header=True)
    others.write.mode("append").csv(folder, header=True)
    return read_folder(spark, folder).select(
        "event_id", "value", "user_id", "DATE", "TIME", F.col("__datetime").alias("event_time")
    )


@query(
    """
    SELECT doc_id, doc_id + 1234567890123450000 AS big, nullif(lang, 'de') AS lang, text FROM documents
    """
)
def read_quoted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with line breaks and quotes, 19-digit numbers and marks of missing values."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.col("doc_id") + 1234567890123450000).alias("big"),
        F.when(F.col("lang") == "de", "NA").otherwise(F.col("lang")).alias("lang"), "text",
    )
    folder = _new_folder(spark)
    docs.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
    return read_folder(spark, folder).select("doc_id", "big", "lang", "text")


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_totalprice, o_orderstatus FROM orders")
def read_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _new_folder(spark) + ".json"
    table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").write.json(folder)
    return read_table(spark, folder)


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def read_json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one list each, some thousand objects long, over several lines."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    documents = 2 + rows.count() // DOCUMENT_ROWS
    dealt = rows.select(F.pmod(F.xxhash64("c_custkey"), F.lit(documents)).alias("d"), F.to_json(F.struct(*rows.columns)).alias("o"))
    lists = dealt.groupBy("d").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("o"), ",\n "), F.lit("]")).alias("value"))
    folder = _new_folder(spark) + ".json"
    lists.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return read_table(spark, folder)


BLANK = (
    r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
    r"\x{205F}\x{3000}]"
)


@query(
    f"""
    WITH t AS (SELECT doc_id, regexp_replace(text, '^{BLANK}+|{BLANK}+$', '', 'g') AS text
               FROM documents)
    SELECT doc_id, CASE WHEN length(text) > 8000
                        THEN substring(text, 1, 8000) || chr(10) || '...(이하 생략)'
                        ELSE text END AS text
    FROM t
    """
)
def doc_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_text(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


def _event_slices(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    events = table(spark, sf_dir, "events")
    return [
        events.filter("event_type = 'view'").select("event_id", "ts", "value"),
        events.filter("event_type <> 'view'").select("value", "event_id", "user_id"),
    ]


SLICES_SQL = """
    SELECT event_id, ts, value FROM events WHERE event_type = 'view'
    UNION ALL BY NAME
    SELECT value, event_id, user_id FROM events WHERE event_type <> 'view'
    """


@query(SLICES_SQL)
def concat_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concat_tables(_event_slices(spark, sf_dir))


@query(SLICES_SQL)
def combine_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine(_event_slices(spark, sf_dir), "concat")


LABELLED_SQL = """
    SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, lang, source, n_chars, quality, toxic
    FROM documents d FULL JOIN labels l ON d.doc_id IS NOT DISTINCT FROM l.doc_id
    """


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return join_tables([docs, table(spark, sf_dir, "labels")], "doc_id")


@query(LABELLED_SQL)
def outer_join_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_documents(spark, sf_dir)


@query(LABELLED_SQL)
def combine_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return combine([docs, table(spark, sf_dir, "labels")], "join", key="doc_id")


@query(
    """
    WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders),
         b AS (SELECT l_orderkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1),
         c AS (SELECT l_orderkey AS k, count(*) AS v FROM lineitem
               WHERE l_returnflag = 'R' GROUP BY 1),
         ab AS (SELECT coalesce(a.k, b.k) AS k, a.v AS v_1, b.v AS v_2
                FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k)
    SELECT coalesce(ab.k, c.k) AS k, v_1, round(v_2, 6) AS v_2, c.v AS v_3
    FROM ab FULL JOIN c ON ab.k IS NOT DISTINCT FROM c.k
    """
)
def outer_join_3way(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey").alias("k")
    joined = join_tables(
        [
            orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")),
            items.groupBy(key).agg(F.sum("l_quantity").alias("v")),
            items.filter("l_returnflag = 'R'").groupBy(key).agg(F.count(F.lit(1)).alias("v")),
        ],
        "k",
        hot_rows=0,  # the key is unique in all three tables
    )
    return joined.withColumn("v_2", F.round("v_2", 6))


@query(
    """
    WITH a AS (SELECT nullif(lang, 'en') AS k, source, count(*) AS n FROM documents GROUP BY 1, 2),
         b AS (SELECT nullif(lang, 'fr') AS k, count(*) AS n FROM documents GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, source, a.n AS n_x, b.n AS n_y
    FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k
    """
)
def outer_join_null_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = F.count(F.lit(1)).alias("n")
    left = docs.groupBy(F.nullif("lang", F.lit("en")).alias("k"), "source").agg(n)
    right = docs.groupBy(F.nullif("lang", F.lit("fr")).alias("k")).agg(n)
    return join_tables([left, right], "k")


def _of_type(spark: SparkSession, sf_dir: str, kind: str, prefix: str, *more: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter(F.col("event_type") == kind)
    return events.select(
        F.col("ts").alias("paid_at"),
        *more,
        F.col("event_id").alias(f"{prefix}_id"),
        F.col("value").alias(f"{prefix}_value"),
    )


SIDES_SQL = """
    WITH p AS (SELECT ts AS paid_at, user_id, event_id AS purchase_id, value AS purchase_value
               FROM events WHERE event_type = 'purchase'),
         v AS (SELECT ts AS paid_at, user_id, event_id AS view_id, value AS view_value
               FROM events WHERE event_type = 'view'),
         b AS (SELECT p.*, v.paid_at AS v_at, view_id, view_value FROM p ASOF LEFT JOIN v ON p.paid_at >= v.paid_at),
         f AS (SELECT p.*, v.paid_at AS v_at, view_id, view_value FROM p ASOF LEFT JOIN v ON p.paid_at <= v.paid_at),
         n AS (SELECT b.paid_at, b.purchase_id, b.purchase_value,
                      f.v_at IS NULL OR b.paid_at - b.v_at <= f.v_at - b.paid_at AS earlier,
                      CASE WHEN earlier THEN b.view_id ELSE f.view_id END AS view_id,
                      CASE WHEN earlier THEN b.view_value ELSE f.view_value END AS view_value,
                      CASE WHEN earlier THEN b.paid_at - b.v_at ELSE f.v_at - b.paid_at END AS gap
               FROM b JOIN f ON b.purchase_id = f.purchase_id)
    """
MATCH_COLUMNS = "paid_at, purchase_id, purchase_value, view_id, view_value"


def _asof(spark: SparkSession, sf_dir: str, direction: str, **options) -> DataFrame:
    purchases = _of_type(spark, sf_dir, "purchase", "purchase")
    views = _of_type(spark, sf_dir, "view", "view")
    return asof_join(purchases, views, "paid_at", "paid_at", direction, **options)


@query(f"{SIDES_SQL} SELECT {MATCH_COLUMNS} FROM b")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, "backward")


@query(f"{SIDES_SQL} SELECT {MATCH_COLUMNS} FROM f")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, "forward")


@query(f"{SIDES_SQL} SELECT {MATCH_COLUMNS} FROM n")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, "nearest")


# Times as four sources might write them, the last one nine hours ahead of UTC.
TEXT_TIMES = {
    "%Y-%m-%d %H:%M:%S": "yyyy-MM-dd HH:mm:ss", "%Y/%m/%d %H:%M:%S": "yyyy/MM/dd HH:mm:ss", "%m/%d/%Y %H:%M:%S": "MM/dd/yyyy HH:mm:ss",
    "%b %d %Y %H:%M:%S": "MMM dd yyyy HH:mm:ss",
}


@query(
    f"""
    WITH e AS (SELECT event_id, event_type, value, CASE event_id % 5
                   {' '.join(f"WHEN {i} THEN strftime(ts, '{f}')" for i, f in enumerate(TEXT_TIMES))}
                   ELSE strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00' END AS said FROM events),
         t AS (SELECT event_id, event_type, value, CASE WHEN said LIKE '%+09:00'
                   THEN strptime(replace(said, '+09:00', ''), '%Y-%m-%dT%H:%M:%S') - INTERVAL 9 HOUR
                   ELSE try_strptime(said, {list(TEXT_TIMES)}) END AS paid_at FROM e),
         p AS (SELECT paid_at, event_id AS purchase_id FROM t WHERE event_type = 'purchase'),
         v AS (SELECT paid_at, max(event_id) AS view_id, arg_max(value, event_id) AS view_value FROM t
               WHERE event_type = 'view' GROUP BY 1)
    SELECT p.paid_at, purchase_id, view_id, view_value FROM p ASOF LEFT JOIN v ON p.paid_at >= v.paid_at
    """
)
def asof_text_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backward join on times given as text in several formats."""
    choice = F.date_format(F.expr("ts + INTERVAL '9' HOUR"), "yyyy-MM-dd'T'HH:mm:ss'+09:00'")
    for i, fmt in enumerate(TEXT_TIMES.values()):
        choice = F.when(F.col("event_id") % 5 == i, F.date_format("ts", fmt)).otherwise(choice)
    events = table(spark, sf_dir, "events").withColumn("paid_at", choice)
    purchases = events.filter("event_type = 'purchase'").select("paid_at", F.col("event_id").alias("purchase_id"))
    views = events.filter("event_type = 'view'").select(
        "paid_at", F.col("event_id").alias("view_id"), F.col("value").alias("view_value")
    )
    return asof_join(purchases, views, "paid_at", "paid_at", "backward", tiebreak=["view_id"])


@query(
    f"""{SIDES_SQL}
    SELECT paid_at, purchase_id, purchase_value,
           CASE WHEN gap <= INTERVAL 5 MINUTE THEN view_id END AS view_id,
           CASE WHEN gap <= INTERVAL 5 MINUTE THEN view_value END AS view_value
    FROM n
    """
)
def asof_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, "nearest", tolerance_seconds=300)


@query(f"{SIDES_SQL} SELECT {MATCH_COLUMNS} FROM n")
def asof_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest join again, cut into many time buckets as on a large table."""
    return _asof(spark, sf_dir, "nearest", bucket_rows=500)


@query(
    f"""{SIDES_SQL}
    SELECT p.user_id, p.paid_at, purchase_id, purchase_value, view_id, view_value
    FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.paid_at >= v.paid_at
    """
)
def asof_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    purchases = _of_type(spark, sf_dir, "purchase", "purchase", "user_id")
    views = _of_type(spark, sf_dir, "view", "view", "user_id")
    return asof_join(purchases, views, "paid_at", "paid_at", "backward", by=["user_id"])


@query(
    """
    WITH l AS (SELECT l_shipdate AS shipped, l_orderkey, l_linenumber, l_partkey FROM lineitem),
         o AS (SELECT o_orderdate AS ordered, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1)
    SELECT shipped, l_orderkey, l_linenumber, l_partkey, o_orderkey, ordered
    FROM l ASOF LEFT JOIN o ON l.shipped >= o.ordered
    """
)
def asof_shared_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many rows per instant on both sides; the last order of the day wins."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("shipped"), "l_orderkey", "l_linenumber", "l_partkey"
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("ordered")
    )
    return asof_join(items, orders, "shipped", "ordered", "backward", tiebreak=["o_orderkey"])


CHAIN_SQL = f"""{SIDES_SQL},
    c AS (SELECT ts AS paid_at, event_id AS click_id, value AS click_value
          FROM events WHERE event_type = 'click'),
    cb AS (SELECT n.*, c.paid_at AS c_at, click_id, click_value FROM n ASOF LEFT JOIN c ON n.paid_at >= c.paid_at),
    cf AS (SELECT n.*, c.paid_at AS c_at, click_id, click_value FROM n ASOF LEFT JOIN c ON n.paid_at <= c.paid_at)
    SELECT cb.paid_at AS event_time, cb.purchase_id, cb.purchase_value, cb.view_id, cb.view_value,
           CASE WHEN cf.c_at IS NULL OR cb.paid_at - cb.c_at <= cf.c_at - cb.paid_at
                THEN cb.click_id ELSE cf.click_id END AS click_id,
           CASE WHEN cf.c_at IS NULL OR cb.paid_at - cb.c_at <= cf.c_at - cb.paid_at
                THEN cb.click_value ELSE cf.click_value END AS click_value,
           'p' AS source_1, 'v' AS source_2, 'c' AS source_3
    FROM cb JOIN cf ON cb.purchase_id = cf.purchase_id
    """


def _folders(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [
        _of_type(spark, sf_dir, kind, kind)
        .withColumnRenamed("paid_at", "__datetime")
        .withColumn("__source", F.lit(kind[0]))
        for kind in ("purchase", "view", "click")
    ]


def _visible(df: DataFrame) -> DataFrame:
    names = {"__datetime": "event_time", **{f"__source_{i}": f"source_{i}" for i in (1, 2, 3)}}
    return df.withColumnsRenamed(names)


@query(CHAIN_SQL)
def asof_chain_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible(asof_chain(_folders(spark, sf_dir), "nearest"))


@query(CHAIN_SQL)
def combine_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible(combine(_folders(spark, sf_dir), "time"))
