"""Free-text documents from files of unknown encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.profile import q
from plumbline.sources.files import LAST_CHARSET, java_charsets, legacy_text

MAX_CHARS = 8000
CUT_MARK = "\n...(이하 생략)"
# The characters that count as blanks at the ends of a text.
BLANKS = (
    r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
BYTE_ORDER_MARK = r"^\x{FEFF}"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANKS}+|{BLANKS}+$", "")


def cap_text(df: DataFrame, col: str, max_chars: int = MAX_CHARS) -> DataFrame:
    """Trim a text column and mark where texts over the limit were cut."""
    text = _strip(q(col))
    cut = F.concat(F.substring(text, 1, max_chars), F.lit(CUT_MARK))
    return df.withColumn(col, F.when(F.length(text) > max_chars, cut).otherwise(text))


def read_text_docs(spark: SparkSession, path: str, max_chars: int = MAX_CHARS) -> DataFrame:
    """One row (name, text) per file, decoded by the first encoding that fits."""
    files = spark.read.format("binaryFile").load(path)
    raw = F.col("content")
    with java_charsets(spark):
        legacy = legacy_text(raw)
        text = (
            F.when(F.is_valid_utf8(raw.cast("string")), F.regexp_replace(raw.cast("string"), BYTE_ORDER_MARK, ""))
            .when(~F.contains(legacy, F.lit("�")), legacy)
            .otherwise(F.decode(raw, LAST_CHARSET))
        )
        docs = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), text.alias("text"))
        return cap_text(docs, "text", max_chars)
