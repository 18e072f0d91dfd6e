import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.functions.times import as_time, without_time

TEN = dt.datetime(2024, 1, 5, 10, 0)
DAY = dt.datetime(2024, 1, 5)


@pytest.mark.parametrize("text, want", [
    ("2024-01-05 10:00:00", TEN), ("2024-01-05T10:00", TEN), (" 2024-01-05 ", DAY), ("2024/01/05 10:00", TEN), ("01/05/2024", DAY),
    ("25/01/2024", dt.datetime(2024, 1, 25)), ("20240105", DAY), ("20240105100000", TEN), ("Jan 5 2024", DAY), ("Jan 5, 2024 10:00", TEN),
    ("January 5, 2024", DAY), ("5 Jan 2024", DAY), ("1.5.2024 10:00:00", TEN), ("25.1.2024", dt.datetime(2024, 1, 25)),
    ("1/5/2024 10:00 AM", TEN), ("2024-01-05 19:00:00+09:00", TEN), ("2024-01-05T19:00:00+0900", TEN), ("2024-01-05T10:00:00Z", TEN),
    ("2024-01-05T10:00:00.25", TEN.replace(microsecond=250000)), ("2024-13-45", None), ("soon", None), ("", None), (None, None), ("12", None),
])
def test_usual_formats(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(as_time(df, "t")).first()[0] == want


def test_a_given_format_is_the_only_one(spark):
    df = spark.createDataFrame([("05|01|2024",), ("2024-01-05",)], "t string")
    got = [r[0] for r in df.select(as_time(df, "t", "dd|MM|yyyy")).collect()]
    assert got == [DAY, None]


def test_offsets_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([("2024-01-05 19:00:00+09:00", "2024-01-05 10:00:00")], "a string, b string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert tuple(df.select(as_time(df, "a"), as_time(df, "b")).first()) == (TEN, TEN)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_rows_without_a_time_are_counted(spark):
    df = spark.createDataFrame([("2024-01-05",), ("never",), (None,)], "t string")
    assert tuple(without_time(df, "t").first()) == (3, 2)
    assert tuple(without_time(df.withColumn("t", F.lit(1)), "t").first()) == (3, 0)
