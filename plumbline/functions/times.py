"""Time parsing and arithmetic on naive timestamps, free of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


# Formats tried besides ISO 8601, by what a text must look like for them; a number before
# a month is a month where it can be. A failed attempt costs far more than the look.
_TIME = "[ H:m[:s]]"
FORMATS = {
    r"^\d{4}/": (f"yyyy/M/d{_TIME}",),
    r"^\d{4}[.]": (f"yyyy.M.d{_TIME}",),
    r"^\d{8}( |$)": ("yyyyMMdd[ HHmmss]",),
    r"^\d{14}$": ("yyyyMMddHHmmss",),
    r"^\d{1,2}/\d{1,2}/\d{4} .*[APap][Mm]$": ("M/d/yyyy h:m[:s] a",),
    r"^\d{1,2}/\d{1,2}/\d{4}": (f"M/d/yyyy{_TIME}", f"d/M/yyyy{_TIME}"),
    r"^\d{1,2}-\d{1,2}-\d{4}": (f"M-d-yyyy{_TIME}", f"d-M-yyyy{_TIME}"),
    r"^\d{1,2}[.]\d{1,2}[.]\d{4}": (f"M.d.yyyy{_TIME}", f"d.M.yyyy{_TIME}"),
    r"^[A-Za-z]{3} \d{1,2},": (f"MMM d, yyyy{_TIME}",),
    r"^[A-Za-z]{3} \d": (f"MMM d yyyy{_TIME}",),
    r"^[A-Za-z]{4,} \d{1,2},": (f"MMMM d, yyyy{_TIME}",),
    r"^[A-Za-z]{4,} \d": (f"MMMM d yyyy{_TIME}",),
    r"^\d{1,2} [A-Za-z]{3} ": (f"d MMM yyyy{_TIME}",),
    r"^\d{1,2} [A-Za-z]{4,} ": (f"d MMMM yyyy{_TIME}",),
}
ISO = r"^\d{4}-\d{1,2}(-\d{1,2})?([T ].*)?$"
OFFSET = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?\s*(Z|UTC|GMT|[+-]\d{1,2}:?\d{2})$"


def as_time(df: DataFrame, col: str, fmt: str | None = None) -> Column:
    """`col` as TIMESTAMP_NTZ; what cannot be parsed becomes NULL.

    Text is read by `fmt` if given, else as ISO 8601 or by the first of FORMATS that
    fits. A time with an offset becomes the time in UTC; one without is taken as it
    stands. Whole numbers count nanoseconds since 1970.
    """
    kind = df.schema[col].dataType
    c = F.col(f"`{col}`")
    if isinstance(kind, T.StringType):
        return text_time(c, fmt)
    if isinstance(kind, T.IntegralType):
        return F.expr(f"timestampadd(MICROSECOND, `{col}` div 1000, TIMESTAMP_NTZ'1970-01-01')")
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def text_time(c: Column, fmt: str | None = None) -> Column:
    """A text column as TIMESTAMP_NTZ, see `as_time`."""
    text = F.trim(c)
    if fmt:
        return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")
    # four digits of offset, as in +0900, become +09:00
    spaced = F.regexp_replace(F.regexp_replace(text, r"\s*(UTC|GMT|Z)$", "+00:00"), r"([+-]\d{1,2})(\d{2})$", "$1:$2")
    instant = F.try_to_timestamp(F.when(text.rlike(OFFSET), spaced))
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    in_utc = F.timestamp_add("MICROSECOND", F.unix_micros(instant), origin)
    read = F.when(text.rlike(ISO), F.when(text.rlike(OFFSET), in_utc).otherwise(text.try_cast("timestamp_ntz")))
    for look, formats in FORMATS.items():
        tried = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
        read = read.when(text.rlike(look), F.coalesce(*tried))
    return read


def without_time(df: DataFrame, col: str, fmt: str | None = None) -> DataFrame:
    """How many rows have no valid time in `col`: they are dropped by whatever orders by it."""
    known = as_time(df, col, fmt)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(known.isNull()).alias("n_without_time"))


def micros(col: str | Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ column."""
    c = F.col(col) if isinstance(col, str) else col
    if SparkSession.active().conf.get("spark.sql.session.timeZone") in UTC_NAMES:
        return F.unix_micros(c.cast("timestamp"))
    # other zones skip and repeat hours, so count from a naive origin: whole seconds and
    # the rest apart, to stay in 64-bit arithmetic
    since = c - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = since.cast("interval second").cast("bigint")
    rest = (since - F.expr("INTERVAL '1' SECOND") * seconds) * 1_000_000
    return seconds * 1_000_000 + rest.cast("interval second").cast("bigint")


def calendar_columns(col: str | Column) -> dict[str, Column]:
    """Year, month, day and day of week with Monday = 0."""
    c = F.col(col) if isinstance(col, str) else col
    return {
        "year": F.year(c),
        "month": F.month(c),
        "day": F.dayofmonth(c),
        "dayofweek": F.weekday(c),
    }
