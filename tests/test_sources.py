import datetime

import pytest

from plumbline.sources.documents import cap_text, read_text_docs
from plumbline.sources.files import (
    read_csv_tolerant,
    read_folder,
    read_table,
    require_rows,
    write_prepared,
)


@pytest.mark.parametrize("ext, sep", [("csv", ","), ("txt", ","), ("tsv", "\t"), ("data", ",")])
def test_read_by_extension(spark, tmp_path, ext, sep):
    path = tmp_path / f"t.{ext}"
    path.write_text(f"a{sep}b\n1{sep}2\n3{sep}4\n")
    assert sorted(map(tuple, read_table(spark, str(path)).collect())) == [(1, 2), (3, 4)]


def test_read_json(spark, tmp_path):
    path = tmp_path / "t.JSON"
    path.write_text('[{"a": 1, "b": 2},\n {"a": 3, "b": 4}]')
    assert sorted(map(tuple, read_table(spark, str(path)).collect())) == [(1, 2), (3, 4)]


BREAKS = 'id,text,n\n1,"line one\nline two",10\n2,"say ""hi"",\n\nbye",20\n3,5" wide,30\n'


@pytest.mark.parametrize("read", ["table", "tolerant", "folder"])
def test_quoted_line_breaks(spark, tmp_path, read):
    (tmp_path / "t.csv").write_text(BREAKS)
    if read == "folder":
        (tmp_path / "u.csv").write_text("id,text,n\n4,plain,40\n")
        got = read_folder(spark, str(tmp_path)).select("id", "text", "n")
    else:
        got = (read_table if read == "table" else read_csv_tolerant)(spark, str(tmp_path / "t.csv"))
    want = [(1, "line one\nline two", 10), (2, 'say "hi",\n\nbye', 20), (3, '5" wide', 30)]
    assert sorted(map(tuple, got.collect())) == want + [(4, "plain", 40)] * (read == "folder")


@pytest.mark.parametrize("content, want", [
    ('{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n\n{"a": 3, "b": null}\n', [(1, "x"), (2, "y"), (3, None)]),
    ('[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]', [(1, "x"), (2, "y")]),
    ('{"a": {"0": 1, "1": 2},\n "b": {"0": "x", "1": "y"}}', [(1, "x"), (2, "y")]),
    ('{"a": [1, 2], "b": ["x", "y"]}', [(1, "x"), (2, "y")]),
])
def test_json_forms(spark, tmp_path, content, want):
    (tmp_path / "t.json").write_text(content)
    assert sorted(map(tuple, read_table(spark, str(tmp_path / "t.json")).select("a", "b").collect())) == want


def test_broken_json_is_refused(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"a": 1}\n{"a": oops}\n{"a": 3}\n')
    with pytest.raises(Exception, match="(?i)malformed|cannot parse|parse"):
        read_table(spark, str(tmp_path / "t.json")).collect()


def test_long_whole_numbers_and_missing_marks(spark, tmp_path):
    rows = "id,huge,x,none\n1234567890123456789,123456789012345678901,1,NA\n1234567890123456788,5,NA,\n-1,6,2.5,null\n"
    (tmp_path / "t.csv").write_text(rows)
    for df in (read_table(spark, str(tmp_path / "t.csv")), read_csv_tolerant(spark, str(tmp_path / "t.csv"))):
        assert dict(df.dtypes) == {"id": "bigint", "huge": "string", "x": "double", "none": "double"}
        assert sorted(r["id"] for r in df.collect()) == [-1, 1234567890123456788, 1234567890123456789]
        assert [r["x"] for r in df.orderBy("id").collect()] == [2.5, None, 1.0]


def test_names_with_an_underscore_are_read(spark, tmp_path):
    (tmp_path / "_x.csv").write_text("a\n1\n")
    assert [tuple(r) for r in read_folder(spark, str(tmp_path)).collect()] == [(1, "_x.csv")]
    (tmp_path / "y.csv").write_text("a\n2\n")
    assert sorted(map(tuple, read_folder(spark, str(tmp_path)).collect())) == [(1, "_x.csv"), (2, "y.csv")]


def test_many_files_take_one_plan_per_header(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"f{i}.csv").write_text(f"a,b\n{i},{i * i}\n")
    df = read_folder(spark, str(tmp_path))
    assert sorted((r["a"], r["b"]) for r in df.collect()) == [(i, i * i) for i in range(30)]
    assert "Union" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_header_search_is_a_parameter(spark, tmp_path):
    (tmp_path / "t.csv").write_text("x\n" * 40 + "a,b\n1,2\n")
    assert read_csv_tolerant(spark, str(tmp_path / "t.csv"), header_lines=50).columns == ["a", "b"]


def test_empty_table_is_refused(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("col1,col2\n")
    with pytest.raises(ValueError, match="empty"):
        require_rows(read_table(spark, str(path)))


def test_prepared_table_keeps_its_types(spark, tmp_path):
    df = spark.createDataFrame([(1, datetime.date(2024, 1, 1))], "i int, d date")
    write_prepared(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).schema == df.schema
    with pytest.raises(ValueError):
        write_prepared(df, str(tmp_path / "q"), "xml")


@pytest.fixture
def folder(tmp_path):
    first = (
        'device log\nserial 5\n\nDATE , TIME,value,이름\n"01.02.2024",10:00:00,1,가\n'
        "01.03.2024, 10:00:01,2,나\nbad\n1,2,3,4,5\n1,2,3,4,\n\n01.04.2024,99:00:00,NA,\"x,y\"\n"
    )
    (tmp_path / "a.csv").write_bytes(first.encode("utf-8-sig"))
    (tmp_path / "b.csv").write_bytes("DATE,TIME,이름,extra\n01.05.2024,11:00:00,홍길동,1.5\n".encode("cp949"))
    (tmp_path / "c.csv").write_bytes(b"DATE,TIME\r\n01.06.2024,12:00:00\r\n")
    (tmp_path / "note.txt").write_text("not a table")
    return str(tmp_path)


def test_folder_of_different_files(spark, folder):
    df = read_folder(spark, folder)
    assert df.columns == ["DATE", "TIME", "value", "이름", "__source", "extra", "__datetime"]
    at = datetime.datetime
    rows = {
        (r["__source"], r["value"], r["이름"], r["extra"], r["__datetime"]) for r in df.collect()
    }
    assert rows == {
        ("a.csv", 1, "가", None, at(2024, 1, 2, 10)),
        ("a.csv", 2, "나", None, at(2024, 1, 3, 10, 0, 1)),
        ("a.csv", None, None, None, None),  # a short row is kept
        ("a.csv", None, "x,y", None, None),  # a bad time becomes NULL
        ("b.csv", None, "홍길동", 1.5, at(2024, 1, 5, 11)),
        ("c.csv", None, None, None, at(2024, 1, 6, 12)),
    }
    assert dict(df.dtypes)["value"] == "bigint"


def test_folder_with_one_time_column_or_none(spark, folder):
    single = read_folder(spark, folder, datetime_col="DATE")
    assert "__datetime" in single.columns
    assert "__datetime" not in read_folder(spark, folder, date_col="day").columns
    with pytest.raises(ValueError, match="no CSV"):
        read_folder(spark, folder + "/none")


def test_tolerant_csv(spark, folder, tmp_path):
    assert read_csv_tolerant(spark, folder + "/b.csv").first()["이름"] == "홍길동"
    late = tmp_path / "late.csv"  # the header lies beyond the searched lines
    late.write_text("x\n" * 31 + "a,b\n1,2\n")
    assert read_csv_tolerant(spark, str(late)).columns == ["x"]
    broken = tmp_path / "broken.csv"
    broken.write_bytes(b"a,b\n\xff\xff,1\n")
    with pytest.raises(ValueError, match="encoding"):
        read_csv_tolerant(spark, str(broken))


def test_text_documents(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes("  홍길동 abc \n".encode("cp949"))
    (tmp_path / "y.txt").write_bytes(("﻿" + "é" * 9000).encode())
    (tmp_path / "z.txt").write_bytes(b"caf\xe9 \xff\xfe x")
    docs = {r["name"]: r["text"] for r in read_text_docs(spark, str(tmp_path)).collect()}
    assert docs["x.txt"] == "홍길동 abc"
    assert docs["y.txt"] == "é" * 8000 + "\n...(이하 생략)"
    assert docs["z.txt"] == "café ÿþ x"


@pytest.mark.parametrize("n, cut", [(7999, False), (8000, False), (8001, True)])
def test_text_limit(spark, n, cut):
    text = cap_text(spark.createDataFrame([("　" + "a" * n + " \n",)], "t string"), "t").first()[0]
    assert text == "a" * min(n, 8000) + ("\n...(이하 생략)" if cut else "")
