import pytest
from pyspark.sql import functions as F

from plumbline.functions.masking import mask_text, mask_value
from plumbline.operators import pii


def found_kinds(df, **options):
    return {r["name"]: r["kind"] for r in pii.detect_pii(df, **options).collect()}


def column(spark, values, kind="string"):
    """A table of a row number and one column `v`."""
    return spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")


@pytest.mark.parametrize("name, kind", [
    ("work_email", "email"), ("Email_Name", "name"), ("연락처", "phone"), ("계좌", "card"), ("weight", None), ("v", None),
])
def test_kind_from_the_column_name_alone(spark, name, kind):
    df = spark.createDataFrame([(1, "q")], f"i int, `{name}` string")
    assert {r["name"]: r["kind"] for r in pii.pii_by_name(df).collect()}[name] == kind


@pytest.mark.parametrize("values, kind", [
    (["ruth@lake.test", "omar@hill.test", "-"], "email"), (["070-5550-0199", "031-4440-0123"], "phone"), ([7, 8, 9], None),
    (["ruth@lake.test", "a", "b"], None), ([None, None], None),
])
def test_kind_from_the_values(spark, values, kind):
    df = column(spark, values, "int" if values[0] == 7 else "string")
    for options in ({"order_by": ["i"]}, {"sample": None}):
        assert found_kinds(df, **options) == ({"v": kind} if kind else {})


@pytest.mark.parametrize("matching, hit", [(25, True), (24, False)])
def test_half_of_the_first_fifty_known_values_decides(spark, matching, hit):
    values = [None] * 30 + ["kim@river.test"] * matching + ["none"] * (50 - matching) + ["lee@river.test"] * 100
    assert found_kinds(column(spark, values), order_by=["i"]) == ({"v": "email"} if hit else {})


def test_nan_is_no_value(spark):
    df = column(spark, [float("nan")] * 60 + [1.5], "double")
    assert [r["kind"] for r in pii.pii_by_value(df, ["i"], columns=["v"]).collect()] == [None]
    seen = pii.first_values(df, {"v": ~pii.missing(df, "v")}, ["i"], 50)
    assert seen == {"v": ["1.5"]}


def test_nested_columns_are_skipped(spark):
    df = spark.createDataFrame([(1, ["ruth@lake.test"])], "i int, parts array<string>")
    assert found_kinds(df, order_by=["i"]) == {}


@pytest.mark.parametrize("kind, pairs", [
    ("email", {"ruth@lake.test": "r***@lake.test", "lake.test": "***", "@lake.test": "***@lake.test", "r@u@lake.test": "r***@u@lake.test"}),
    ("phone", {"070-5550-0199": "070-****-0199", "0199": "***"}),
    ("resident_id", {"850412-2000001": "850412-*******", "85041": "***"}),
    ("card", {"9000-1111-2222-7777": "****-****-****-7777", "77": "***"}),
    ("name", {"Ruth": "R***", "R": "R*", "": "***", None: None}),
    ("address", {"12 Hill Road": "***"}),
])
def test_masks_of_single_values(spark, kind, pairs):
    df = column(spark, list(pairs))
    assert [r[0] for r in df.orderBy("i").select(mask_value("v", kind)).collect()] == list(pairs.values())


@pytest.mark.parametrize("text, masked, longest_first", [
    ("ask ruth@lake.test or 070-5550-0199 today", "ask r***@lake.test or 070-****-0199 today", False),
    ("room 12, floor 3, since 1987", "room 12, floor 3, since 1987", False),
    ("9000-1111-2222-7777 paid", "****-****-****-7777 paid", True),
    (None, None, False),
])
def test_masks_inside_text(spark, text, masked, longest_first):
    df = column(spark, [text])
    assert df.select(mask_text("v", longest_first=longest_first)).first()[0] == masked


def test_order_of_masks_matters_for_long_numbers(spark):
    df = column(spark, ["1030-5555-0000-4444"])
    assert df.select(mask_text("v")).first()[0] != df.select(mask_text("v", longest_first=True)).first()[0]


def test_masked_labels_that_collide_add_up(spark):
    dist = spark.createDataFrame([("rita@sea.test", 3), ("rosa@sea.test", 4), ("other", 5)], "label string, n bigint")
    assert {tuple(r) for r in pii.mask_distribution(dist).collect()} == {("r***@sea.test", 7), ("other", 5)}


def test_detected_columns_are_masked_and_reported(spark):
    df = spark.createDataFrame([("Omar", "omar@hill.test", 1)], "name string, mail string, v int")
    found = pii.detect_pii(df, order_by=["v"])
    assert pii.mask_table(df, found).first() == ("O***", "o***@hill.test", 1)
    assert {r["name"] for r in pii.pii_report(found).collect()} == {"name", "mail"}


def test_masking_also_runs_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("dial 070-5550-0199",)], "t string").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("t string").parquet(str(tmp_path / "in"))
    out = rows.select(mask_text(F.col("t")).alias("t"))
    query = out.writeStream.format("memory").queryName("masked").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("masked").first()["t"] == "dial 070-****-0199"
