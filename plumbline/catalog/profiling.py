"""Queries on profiles and personal data."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.combining import LABELLED_SQL, labelled_documents
from plumbline.catalog.registry import TABLES, query, table
from plumbline.functions.masking import KIND_LABELS, NAME_PATTERNS, VALUE_PATTERNS, mask_text, mask_value
from plumbline.operators import pii
from plumbline.operators import profile as prof


def _kinds_sql(name: str, columns: dict[str, str], keys: str = "") -> str:
    """infer_schema in SQL: columns maps each name to its kind, '?' for text."""
    rows = []
    for i, (c, kind) in enumerate(columns.items()):
        few = f"count(DISTINCT {c}) < 20"
        data_type = (
            f"CASE WHEN {few} THEN 'CATEGORICAL' ELSE 'TEXT' END" if kind == "?" else f"'{kind}'"
        )
        n_unique = f"CASE WHEN {few} THEN count(DISTINCT {c}) END" if kind == "?" else "NULL::BIGINT"
        rows.append(
            f"SELECT '{name}' AS table_name, {i} AS ordinal, '{c}' AS name, "
            f"{data_type} AS data_type, {n_unique} AS n_unique"
            + (f" FROM {name}" if kind == "?" else "")
        )
    return " UNION ALL ".join(rows)


COLUMN_KINDS = {
    "events": {"event_id": "NUMERIC", "ts": "DATETIME", "user_id": "NUMERIC", "event_type": "?",
               "value": "NUMERIC", "props": "?"},
    "customer": {"c_custkey": "NUMERIC", "c_name": "?", "c_nationkey": "NUMERIC",
                 "c_acctbal": "NUMERIC", "c_mktsegment": "?"},
    "lineitem": {"l_orderkey": "NUMERIC", "l_partkey": "NUMERIC", "l_suppkey": "NUMERIC",
                 "l_linenumber": "NUMERIC", "l_quantity": "NUMERIC", "l_extendedprice": "NUMERIC",
                 "l_discount": "NUMERIC", "l_tax": "NUMERIC", "l_returnflag": "?",
                 "l_linestatus": "?", "l_shipdate": "DATETIME"},
    "embeddings": {"vec_id": "NUMERIC", "embedding": "UNSUPPORTED", "label": "NUMERIC"},
}


@query(" UNION ALL ".join(_kinds_sql(t, cols) for t, cols in COLUMN_KINDS.items()))
def infer_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        prof.infer_schema(table(spark, sf_dir, t)).withColumn("table_name", F.lit(t))
        for t in COLUMN_KINDS
    ]
    return reduce(DataFrame.unionByName, parts)


PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query(
    " UNION ALL ".join(
        f"""(SELECT {i} AS ordinal, '{c}' AS name,
                    CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS position,
                    CAST({c} AS VARCHAR) AS value
             FROM part WHERE {c} IS NOT NULL ORDER BY p_partkey LIMIT 3)"""
        for i, c in enumerate(PART_COLUMNS)
    )
)
def column_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.column_samples(table(spark, sf_dir, "part").select(*PART_COLUMNS), ["p_partkey"])


WIDTHS = dict(zip(TABLES, (2, 3, 5, 4, 6, 6, 11, 6, 5, 3, 3, 2, 3, 4)))


@query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS name, count(*) AS n_rows, {w} AS n_columns FROM {t}"
        for t, w in WIDTHS.items()
    )
)
def profile_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(
        DataFrame.unionByName, [prof.shape(table(spark, sf_dir, t), t) for t in TABLES]
    )


LABELLED_COLUMNS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]


@query(
    f"WITH j AS ({LABELLED_SQL}) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS name, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM j"
        for c in LABELLED_COLUMNS
    )
)
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.null_counts(labelled_documents(spark, sf_dir))


@query("SELECT CAST(quality AS VARCHAR) AS label, count(*) AS n FROM labels GROUP BY 1")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.class_distribution(table(spark, sf_dir, "labels"), "quality")


@query("SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1")
def class_distribution_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.class_distribution(table(spark, sf_dir, "events"), "event_type")


def _stats_sql(name: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS name, round(avg(CAST({c} AS DOUBLE)), 4) AS mean,
                   round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std,
                   CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM {name}"""
        for c in cols
    )


def _rounded_stats(stats: DataFrame) -> DataFrame:
    return stats.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


ITEM_NUMBERS = [c for c, kind in COLUMN_KINDS["lineitem"].items() if kind == "NUMERIC"]


@query(_stats_sql("lineitem", ITEM_NUMBERS))
def numeric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_stats(prof.numeric_stats(table(spark, sf_dir, "lineitem")))


@query(_stats_sql("orders", ["o_totalprice"]))
def target_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_stats(prof.target_stats(table(spark, sf_dir, "orders"), "o_totalprice"))


PRICED = {
    "net": "l_extendedprice * (1 - l_discount)",
    "gross": "l_extendedprice * (1 - l_discount) * (1 + l_tax)",
    "boxes": "ceil(l_quantity / 5)",
}
PRICED_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", *PRICED]


def priced_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.selectExpr(
        *PRICED_COLUMNS[:4], *[f"CAST({sql} AS DOUBLE) AS {c}" for c, sql in PRICED.items()]
    )


PRICED_SQL = f"""
    SELECT {', '.join(PRICED_COLUMNS[:4])},
           {', '.join(f'CAST({sql} AS DOUBLE) AS {c}' for c, sql in PRICED.items())}
    FROM lineitem
    """
PAIRS = [
    (a, b)
    for i, a in enumerate(PRICED_COLUMNS)
    for b in PRICED_COLUMNS[i + 1 :]
    if "l_extendedprice" not in (a, b)
]


@query(
    f"WITH x AS ({PRICED_SQL}), c AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM x" for a, b in PAIRS)
    + ") SELECT a, b, round(corr, 6) AS corr FROM c WHERE abs(corr) > 0.9 "
    "ORDER BY abs(corr) DESC, a, b LIMIT 10"
)
def high_corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = prof.high_corr_pairs(priced_items(spark, sf_dir), "l_extendedprice")
    return pairs.withColumn("corr", F.round("corr", 6))


WIDE = {
    f"c{k}": f"CASE WHEN (l_orderkey + l_linenumber + {k}) % 10 <> 0 "
    f"THEN CAST(l_quantity * {k} + l_discount * {k * k % 11} * 100 + l_tax * {k % 3} AS DOUBLE) END"
    for k in range(1, 41)
}


@query(
    f"WITH x AS MATERIALIZED (SELECT {', '.join(f'{sql} AS {c}' for c, sql in WIDE.items())} FROM lineitem), r AS ("
    "SELECT unnest(["
    + ", ".join(f"{{'a': '{a}', 'b': '{b}', 'corr': corr({a}, {b})}}" for a, b in combinations(WIDE, 2))
    + "]) AS p FROM x) SELECT p.a, p.b, round(p.corr, 6) AS corr FROM r"
)
def high_corr_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of 40 columns of which no row is complete."""
    wide = table(spark, sf_dir, "lineitem").select(*[F.expr(sql).alias(c) for c, sql in WIDE.items()])
    return prof.correlations(wide, list(WIDE)).withColumn("corr", F.round("corr", 6))


@query(
    f"""
    WITH p AS ({_kinds_sql('customer', COLUMN_KINDS['customer'])})
    SELECT ordinal, name, data_type, n_unique,
           CASE name WHEN 'c_acctbal' THEN 'balance of the account'
                     WHEN 'c_mktsegment' THEN 'market segment' ELSE '' END AS description,
           name = 'c_acctbal' AS is_target
    FROM p
    """
)
def annotate_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = spark.createDataFrame(
        [
            ("c_mktsegment", " market segment ", True),
            ("c_acctbal", "balance of the account", True),
            ("unknown", "not a column", False),
        ],
        "name string, description string, is_target boolean",
    )
    return prof.annotate_schema(prof.infer_schema(table(spark, sf_dir, "customer")), spec)


CUSTOMER_COLUMNS = list(COLUMN_KINDS["customer"])
CUSTOMER_NUMBERS = [c for c, kind in COLUMN_KINDS["customer"].items() if kind == "NUMERIC"]


@query(
    "SELECT 'shape' AS section, 'table' AS name, 'rows' AS stat, CAST(count(*) AS DOUBLE) AS value"
    " FROM customer UNION ALL SELECT 'shape', 'table', 'columns', 5.0"
    + "".join(
        f" UNION ALL SELECT 'null_counts', '{c}', 'nulls', "
        f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) FROM customer"
        for c in CUSTOMER_COLUMNS
    )
    + "".join(
        f" UNION ALL SELECT 'numeric_stats', '{c}', '{s}', round({f}(CAST({c} AS DOUBLE)), 4) FROM customer"
        for c in CUSTOMER_NUMBERS
        for s, f in {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}.items()
    )
    + " UNION ALL SELECT 'class_distribution', c_mktsegment, 'rows', CAST(count(*) AS DOUBLE)"
    " FROM customer GROUP BY 2"
)
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prof.profile(table(spark, sf_dir, "customer"), "c_mktsegment")
    return rows.withColumn("value", F.round("value", 4))


ANCHORED = {k: f"^{p}$" for k, p in VALUE_PATTERNS.items()}
NAME_HITS = {
    "customer": [("c_name", "name")],
    "supplier": [("s_name", "name")],
    "part": [("p_name", "name")],
    "nation": [("n_name", "name")],
    "region": [("r_name", "name")],
    "documents": [],
    "conversations": [],
    "orders": [],
}
KEYS = {
    "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
    "nation": ["n_nationkey"], "region": ["r_regionkey"], "documents": ["doc_id"],
    "conversations": ["conv_id", "turn"], "orders": ["o_orderkey"],
}
VALUE_COLUMNS = {
    "customer": ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_brand", "p_type", "p_size", "p_retailprice"],
    "nation": ["n_nationkey", "n_regionkey"],
    "region": ["r_regionkey"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "conversations": ["conv_id", "turn", "role", "text"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
}


def _first_kind_sql(value: str) -> str:
    cases = " ".join(
        f"WHEN avg(CAST(regexp_matches({value}, '{p}') AS DOUBLE)) >= 0.5 THEN '{k}'"
        for k, p in ANCHORED.items()
    )
    return f"CASE {cases} END"


def _detect_sql() -> str:
    rows = [
        f"SELECT '{t}' AS table_name, '{c}' AS name, '{k}' AS kind"
        for t, hits in NAME_HITS.items()
        for c, k in hits
    ]
    for t, cols in VALUE_COLUMNS.items():
        for c in cols:
            rows.append(
                f"""SELECT '{t}', '{c}', {_first_kind_sql('value')} FROM
                    (SELECT CAST({c} AS VARCHAR) AS value FROM {t} WHERE {c} IS NOT NULL
                     ORDER BY {', '.join(KEYS[t])} LIMIT 50)"""
            )
    labels = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KIND_LABELS.items())
    return (
        f"WITH d AS ({' UNION ALL '.join(rows)}) "
        f"SELECT table_name, name, kind, CASE kind {labels} END AS label FROM d WHERE kind IS NOT NULL"
    )


def _name_kinds_sql() -> str:
    cases = " ".join(f"WHEN regexp_matches(name, '{p}', 'i') THEN '{k}'" for k, p in NAME_PATTERNS.items())
    columns = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, CAST(row_number() OVER () - 1 AS INTEGER) AS ordinal, column_name AS name FROM (DESCRIBE {t})"
        for t in KEYS
    )
    return f"SELECT table_name, ordinal, name, CASE {cases} END AS kind FROM ({columns})"


@query(_name_kinds_sql())
def pii_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [pii.pii_by_name(table(spark, sf_dir, t)).select(F.lit(t).alias("table_name"), "*") for t in KEYS]
    return reduce(DataFrame.unionByName, parts)


@query(_detect_sql())
def detect_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for t, key in KEYS.items():
        found = pii.pii_report(pii.detect_pii(table(spark, sf_dir, t), order_by=key))
        parts.append(found.select(F.lit(t).alias("table_name"), "name", "kind", "label"))
    return reduce(DataFrame.unionByName, parts)


def found_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First e-mail, phone, resident id and card-like number of every document."""
    docs = table(spark, sf_dir, "documents")
    found = {
        f"v{i}": F.nullif(F.regexp_extract("text", p, 0), F.lit(""))
        for i, p in enumerate(VALUE_PATTERNS.values())
    }
    return docs.select("doc_id", *[c.alias(k) for k, c in found.items()])


FOUND_SQL = (
    "SELECT doc_id, "
    + ", ".join(
        f"nullif(regexp_extract(text, '{p}'), '') AS v{i}"
        for i, p in enumerate(VALUE_PATTERNS.values())
    )
    + " FROM documents"
)


@query(
    f"WITH f AS ({FOUND_SQL}) "
    + " UNION ALL ".join(
        f"SELECT {i} AS ordinal, '{c}' AS name, {_first_kind_sql(f'CAST({c} AS VARCHAR)')} AS kind FROM f"
        for i, c in enumerate(["doc_id", "v0", "v1", "v2", "v3"])
    )
)
def pii_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_by_value(found_values(spark, sf_dir), sample=None)


MASK_SQL = {
    "email": "CASE WHEN contains({v}, '@') THEN left(split_part({v}, '@', 1), 1) || '***@' || "
    "substring({v}, instr({v}, '@') + 1) ELSE '***' END",
    "phone": "CASE WHEN length(regexp_replace({v}, '\\D', '', 'g')) >= 7 THEN "
    "left(regexp_replace({v}, '\\D', '', 'g'), 3) || '-****-' || "
    "right(regexp_replace({v}, '\\D', '', 'g'), 4) ELSE '***' END",
    "resident_id": "CASE WHEN length(regexp_replace({v}, '[-\\s]', '', 'g')) >= 6 THEN "
    "left(regexp_replace({v}, '[-\\s]', '', 'g'), 6) || '-*******' ELSE '***' END",
    "card": "CASE WHEN length(regexp_replace({v}, '\\D', '', 'g')) >= 4 THEN '****-****-****-' || "
    "right(regexp_replace({v}, '\\D', '', 'g'), 4) ELSE '***' END",
    "name": "CASE WHEN {v} = '' THEN '***' ELSE left({v}, 1) || "
    "repeat('*', greatest(length({v}) - 1, 1)) END",
    "address": "'***'",
}


def _mask_sql(value: str, kind: str) -> str:
    return f"CASE WHEN {value} IS NOT NULL THEN {MASK_SQL[kind].format(v=value)} END"


@query(f"SELECT c_custkey, {_mask_sql('c_name', 'name')} AS c_name FROM customer")
def mask_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", mask_value("c_name", "name").alias("c_name")
    )


@query(
    f"WITH f AS ({FOUND_SQL}) SELECT doc_id, "
    + ", ".join(f"{_mask_sql(f'v{i}', k)} AS {k}" for i, k in enumerate(VALUE_PATTERNS))
    + f", {_mask_sql('v0', 'address')} AS address, {_mask_sql('v3', 'email')} AS wrong_kind FROM f"
)
def mask_value_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_values(spark, sf_dir).select(
        "doc_id",
        *[mask_value(f"v{i}", k).alias(k) for i, k in enumerate(VALUE_PATTERNS)],
        mask_value("v0", "address").alias("address"),
        mask_value("v3", "email").alias("wrong_kind"),
    )


TEXT_MASK_SQL = {
    "email": (r"([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", r"\1***@\2"),
    "phone": (
        r"0(\d)(?:(\d)[-.\s]?\d{3,4}|[-.\s]?(\d)\d{2,3})[-.\s]?(\d{4})", r"0\1\2\3-****-\4",
    ),
    "resident_id": (r"(\d{6})[-\s]?[1-4]\d{6}", r"\1-*******"),
    "card": (r"\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?(\d{4})", r"****-****-****-\1"),
}


def _mask_text_sql(text: str, order: tuple[str, ...] = ("email", "phone", "resident_id", "card")) -> str:
    for kind in order:
        pattern, mask = TEXT_MASK_SQL[kind]
        text = f"regexp_replace({text}, '{pattern}', '{mask}', 'g')"
    return text


@query(f"SELECT doc_id, {_mask_text_sql('text')} AS text FROM documents")
def mask_text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", mask_text("text").alias("text"))


@query(
    f"SELECT doc_id, {_mask_text_sql('text', ('email', 'card', 'resident_id', 'phone'))} AS text "
    "FROM documents"
)
def mask_text_longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = mask_text("text", longest_first=True).alias("text")
    return table(spark, sf_dir, "documents").select("doc_id", masked)


@query(f"SELECT conv_id, turn, role, {_mask_text_sql('text')} AS text FROM conversations")
def mask_text_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("text", mask_text("text"))


@query(
    f"""
    WITH f AS ({FOUND_SQL}),
         d AS (SELECT coalesce(v0, v1, v2, v3) AS label, count(*) AS n FROM f
               WHERE coalesce(v0, v1, v2, v3) IS NOT NULL GROUP BY 1)
    SELECT {_mask_text_sql('label')} AS label, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY 1
    """
)
def mask_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = found_values(spark, sf_dir).withColumn("found", F.coalesce("v0", "v1", "v2", "v3"))
    return pii.mask_distribution(prof.class_distribution(found, "found"))


@query(
    f"""
    SELECT c_custkey, {_mask_sql('c_name', 'name')} AS c_name, c_nationkey, c_acctbal, c_mktsegment
    FROM customer
    """
)
def mask_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return pii.mask_table(customer, pii.detect_pii(customer, order_by=["c_custkey"]))
