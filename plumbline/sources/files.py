"""Tolerant file ingest: formats by extension, encodings, preambles, folders.

Tolerant CSV files are read as lines, so large files split over many tasks. Where a quoted
field holds a line break, lines are put together to records again, also by many tasks
(`records.py`). A first look at the files finds charset, header and open quotes; then the
records are staged once as Parquet, because types and data each need a look at them.
"""

from __future__ import annotations

import csv
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.times import as_time
from plumbline.operators.combine import concat_tables
from plumbline.operators.durable import materialize, stage_path
from plumbline.operators.profile import q
from plumbline.operators.skew import broadcast_if_small
from plumbline.sources.records import COPIED, block_states, closing, cut_alike, json_objects, quoted_records, text_lines

HEADER_SEARCH_LINES = 30
LEGACY_CHARSET = "x-windows-949"  # the Java name of cp949
LAST_CHARSET = "ISO-8859-1"
END = "\x01"  # appended to every line to tell short rows from long ones
WHOLE_NUMBER = r"^\s*[+-]?\d+\s*$"

# Texts that count as missing.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


# What every value of a column must look like to be of a type, narrowest type first.
TYPE_PATTERNS = {
    "bigint": r"^\s*[+-]?\d{1,19}\s*$",
    "double": r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$",
    "boolean": r"^(true|True|TRUE|false|False|FALSE)$",
}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read one table by its extension: csv, txt, tsv or json; others count as csv.

    Texts that mark missing values become NULL, then types are inferred. Quoted fields
    may hold line breaks; a quote that is never closed ends with its line.
    """
    name = path.lower().rstrip("/")
    if name.endswith(".json"):
        return _read_json(spark, path)
    sep = "\t" if name.endswith(".tsv") else ","
    lines = spark.read.text(path)
    if lines.filter(~closing(F.col("value"), sep)["closed"]).isEmpty():
        text = spark.read.csv(path, header=True, sep=sep, escape='"')
    else:
        text = _read_records(spark, path, sep)
    return infer_types(text.select(*[_known(q(c)).alias(c) for c in text.columns]), ())


def _read_records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Delimited files whose records span lines, all columns as text; each file has its header."""
    # only the first record is read for the names
    columns = spark.read.csv(path, header=True, sep=sep, escape='"', multiLine=True).columns
    lines = text_lines(spark, [path], sep)
    with cut_alike(spark):
        records = quoted_records(lines, block_states(lines).withColumn("kind", F.lit(0)))
    records = records.withColumn("text", F.col("raw").cast("string")).filter(F.length(F.trim("text")) > 0)
    headers = materialize(records.groupBy("path").agg(F.min(F.struct("block", "at")).alias("header")))
    body = records.join(broadcast_if_small(headers), "path").filter(F.struct("block", "at") != F.col("header"))
    schema = ", ".join(f"c{i} string" for i in range(len(columns)))
    row = F.from_csv("text", schema, {"escape": '"', "sep": sep, "mode": "PERMISSIVE"})
    parsed = body.select(row.alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)])


def _known(value: Column, *more: str) -> Column:
    """The text, or NULL where it marks a missing value."""
    return F.when(~value.isin([*MISSING, *more]), value)


def _read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON as lines of records, as one list of records, or by column; never a part of a file.

    Lines and lists split over tasks; the form by column is one document, which one task parses.
    """
    start = spark.read.option("lineSep", "}").text(path).select(F.ltrim(F.regexp_replace("value", r"[\x{FEFF}\s]+", " ")).alias("s"))
    first = start.filter("s <> ''").first()
    if first is not None and first["s"].startswith("["):
        folder = f"{stage_path(spark, 'objects')}/lines"
        json_objects(spark, path).write.text(folder)
        return spark.read.option("mode", "FAILFAST").json(folder)
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''")
    n, records = lines.agg(F.count(F.lit(1)), F.count_if(F.col("line").rlike(r"^\{.*\}$"))).first()
    if n > 1 and n == records:
        return spark.read.option("mode", "FAILFAST").json(path)
    whole = spark.read.text(path, wholetext=True)
    outer = F.from_json("value", "map<string,string>")
    forms = whole.select(F.explode(F.map_values(outer)).alias("v")).select(F.substring(F.trim("v"), 1, 1).alias("f"))
    found = {r["f"] for r in forms.distinct().limit(3).collect()}
    if found == {"{"} or found == {"["}:
        by_key = found == {"{"}
        cells = F.from_json("value", f"map<string,{'map<string,string>' if by_key else 'array<string>'}>")
        columns = whole.select(F.explode(cells).alias("name", "cells"))
        inner = F.explode("cells") if by_key else F.posexplode("cells")
        values = columns.select("name", inner.alias("row", "value"))
        names = [r["name"] for r in columns.select("name").distinct().orderBy("name").collect()]  # one per column
        table = values.groupBy("row").pivot("name", names).agg(F.first("value"))
        return infer_types(table.drop("row"), ())
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)


def require_rows(df: DataFrame, what: str = "table") -> DataFrame:
    """The table itself, or an error when it has no rows."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def write_prepared(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Store a prepared table; Parquet keeps the types, csv is for exchange."""
    writer = df.write.mode("errorifexists")
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.csv(path, header=True)
    else:
        raise ValueError("fmt must be 'parquet' or 'csv'")


@contextmanager
def java_charsets(spark: SparkSession):
    """In expressions built inside, allow all Java charsets and replace bad bytes."""
    confs = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    before = {c: spark.conf.get(c) for c in confs}
    for c in confs:
        spark.conf.set(c, "true")
    try:
        yield
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)


def legacy_text(raw: Column) -> Column:
    """Bytes decoded as cp949; undecodable bytes become U+FFFD."""
    return F.decode(raw, LEGACY_CHARSET)


def _visible(spark: SparkSession, pattern: str) -> list[str]:
    """The pattern, and copies of the files that Spark would skip because of their names.

    Spark takes names that begin with _ or . for its own; such files are copied to a
    stage folder under another name. Hidden files, with a dot, stay hidden.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    glob = jvm.org.apache.hadoop.fs.Path(pattern)
    system = glob.getFileSystem(conf)
    found = [f.getPath() for f in system.globStatus(glob) or []]
    skipped = [f for f in found if f.getName().startswith("_")]
    if not skipped:
        return [pattern]
    folder = stage_path(spark, "named")
    for f in skipped:
        copy = jvm.org.apache.hadoop.fs.Path(f"{folder}/{COPIED}{f.getName()}")
        jvm.org.apache.hadoop.fs.FileUtil.copy(system, f, copy.getFileSystem(conf), copy, False, conf)
    return ([pattern] if len(skipped) < len(found) else []) + [folder]


def _refuse_broken(lines: DataFrame, files: DataFrame) -> None:
    """An error when a file is neither UTF-8 nor in the legacy charset."""
    odd = materialize(files.filter("NOT utf8").select("path"))
    if odd.isEmpty():
        return
    bad = lines.join(broadcast_if_small(odd), "path", "left_semi").filter(F.contains(legacy_text(F.col("raw")), F.lit("�")))
    broken = [r["__source"] for r in bad.select("__source").distinct().orderBy("__source").limit(20).collect()]
    if broken:
        raise ValueError(f"unknown text encoding: {broken}")


def _column_names(header: str) -> tuple[str, ...]:
    names, seen = [], {}
    for i, name in enumerate(next(csv.reader([header]), [])):
        name = name or f"Unnamed: {i}"
        n = seen.get(name, 0)
        seen[name] = n + 1
        names.append((f"{name}.{n}" if n else name).strip())
    return tuple(names)


def _parse(records: DataFrame, header: bytes, utf8: bool) -> DataFrame:
    """Rows of files with one charset and one header, all columns as text."""
    columns = _column_names(header.decode("utf-8-sig" if utf8 else "cp949"))
    text = F.col("raw").cast("string") if utf8 else legacy_text(F.col("raw"))
    body = records.select("__source", text.alias("text"))
    fields = [f"c{i}" for i in range(len(columns) + 1)]
    schema = ", ".join(f"{c} string" for c in fields)
    row = F.from_csv(F.concat("text", F.lit("," + END)), schema, {"escape": '"', "mode": "PERMISSIVE"})
    parsed = body.filter(F.length(F.trim("text")) > 0).select("__source", row.alias("r"))
    # END is in the extra field of a complete row and earlier in a short one
    complete = F.array_contains(F.array(*[F.coalesce(F.col(f"r.{c}"), F.lit("")) for c in fields]), END)
    values = [_known(F.col(f"r.{c}"), END).alias(name) for c, name in zip(fields, columns)]
    return parsed.filter(complete).select(*values, "__source")


def infer_types(df: DataFrame, keep: tuple[str, ...] = ("__source",)) -> DataFrame:
    """Cast text columns to BIGINT, DOUBLE or BOOLEAN where every value allows it.

    Whole numbers beyond 64 bits stay text, since DOUBLE would change them.
    """
    cols = [c for c in df.columns if c not in keep]
    if not cols:
        return df
    # patterns first: a failed cast of every row would cost far more than the match
    fits = {
        kind: {c: q(c).rlike(pattern) for c in cols} for kind, pattern in TYPE_PATTERNS.items()
    }
    in_range = {c: F.trim(q(c)).try_cast("bigint").isNotNull() for c in cols}
    fits["bigint"] = {c: F.when(q(c).isNotNull(), fit & in_range[c]) for c, fit in fits["bigint"].items()}
    fits["whole"] = {c: q(c).rlike(WHOLE_NUMBER) for c in cols}
    row = df.agg(
        *[F.bool_and(fit).alias(f"{kind}|{c}") for kind, of in fits.items() for c, fit in of.items()]
    ).first()

    def typed(c: str) -> Column:
        if row[f"boolean|{c}"] is None:  # no value at all
            return q(c).cast("double")
        kind = next((k for k in TYPE_PATTERNS if row[f"{k}|{c}"]), None)
        if kind == "double" and row[f"whole|{c}"]:
            return q(c)
        return F.trim(q(c)).try_cast(kind) if kind else q(c)

    return df.withColumns({c: typed(c) for c in cols})


def _read_lines(spark: SparkSession, pattern: str, infer: bool, header_lines: int) -> DataFrame:
    try:
        lines = text_lines(spark, _visible(spark, pattern))
    except AnalysisException as error:
        raise ValueError(f"no CSV file found: {pattern}") from error
    with java_charsets(spark), cut_alike(spark):
        blocks = block_states(lines, max(1, header_lines))
        files = blocks.filter("block = 0")
        _refuse_broken(lines, files)
        # one entry per different header, however many files share it
        kinds = files.groupBy("header", "utf8").agg(F.min("__source").alias("first")).orderBy("first", "header").collect()
        if not kinds:
            raise ValueError(f"no lines in {pattern}")
        numbers = spark.createDataFrame([(k["header"], k["utf8"], i) for i, k in enumerate(kinds)], "header binary, utf8 boolean, kind int")
        records = quoted_records(lines, blocks.join(numbers, ["header", "utf8"]))
        parts = [_parse(records.filter(F.col("kind") == i), bytes(k["header"]), k["utf8"]) for i, k in enumerate(kinds)]
        merged = concat_tables(parts)
        return infer_types(merged) if infer else merged


def read_csv_tolerant(
    spark: SparkSession, path: str, infer: bool = True, header_lines: int = HEADER_SEARCH_LINES
) -> DataFrame:
    """Read CSV whatever its encoding (UTF-8 with or without mark, cp949).

    Lines before the first one with a comma, searched in the first `header_lines`, are
    skipped; rows with too many fields are dropped and short ones filled with NULL.
    """
    return _read_lines(spark, path, infer, header_lines).drop("__source")


def read_folder(
    spark: SparkSession,
    folder: str,
    date_col: str = "DATE",
    time_col: str = "TIME",
    fmt: str = "MM.dd.yyyy HH:mm:ss",
    datetime_col: str = "",
    infer: bool = True,
    datetime_fmt: str | None = None,
    header_lines: int = HEADER_SEARCH_LINES,
) -> DataFrame:
    """All CSV files of a folder by column name, with `__source` and `__datetime`.

    `__datetime` comes from `datetime_col` if that column exists, else from the date
    and time columns; without either there is none. Bad times are NULL.
    """
    text = _read_lines(spark, f"{folder.strip().rstrip('/')}/*.csv", False, header_lines)
    if datetime_col and datetime_col in text.columns:
        when = as_time(text, datetime_col, datetime_fmt)
    elif date_col in text.columns and time_col in text.columns:
        both = F.concat_ws(" ", *[F.trim(F.btrim(q(c), F.lit('"'))) for c in (date_col, time_col)])
        when = F.try_to_timestamp(both, F.lit(fmt)).cast("timestamp_ntz")
    else:
        when = None
    text = text if when is None else text.withColumn("__datetime", when)
    return infer_types(text, ("__source", "__datetime")) if infer else text
