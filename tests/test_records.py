"""Records that span lines: against Python's own readers, over many small blocks."""

import contextlib
import csv
import io
import json
import random
import string
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.sources import records
from plumbline.sources.files import read_csv_tolerant, read_folder, read_table
from plumbline.sources.records import block_states, cut_alike, json_objects, quoted_records, text_lines


@contextlib.contextmanager
def blocks_of(spark, size):
    """Files are cut into blocks of `size` bytes."""
    confs = {
        "spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1",
        "spark.sql.adaptive.enabled": "false",  # it would merge the few bytes of a test into one task
    }
    before = {c: spark.conf.get(c) for c in confs}
    for c, v in confs.items():
        spark.conf.set(c, v)
    try:
        yield
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def table_text(rng, n, sep):
    """Fields with quotes, separators and line breaks in them, some quotes within bare fields."""
    out = io.StringIO()
    writer = csv.writer(out, delimiter=sep, lineterminator="\n")
    writer.writerow(["id", "a", "b"])
    for i in range(n):
        cell = ["".join(rng.choice(["x", "yz", '"', "\n", sep, " ", "é"]) for _ in range(rng.randint(1, 6))) for _ in range(2)]
        if rng.random() < 0.3:
            out.write(f'k{i}{sep}v5" wide{sep}w"\n')
        else:
            writer.writerow([f"k{i}", "v" + cell[0], "w" + cell[1] + "."])
    return out.getvalue()


@pytest.mark.parametrize(("size", "ext", "sep"), [(997, "csv", ","), (1700, "tsv", "\t")])
def test_rows_equal_the_csv_reader(spark, tmp_path, size, ext, sep):
    rng = random.Random(size)
    want = []
    for name in "pq":
        text = table_text(rng, 300, sep)
        (tmp_path / f"{name}.{ext}").write_text(text)
        want += [tuple(r) for r in csv.reader(io.StringIO(text), delimiter=sep)][1:]
    with blocks_of(spark, size):
        path = tmp_path / f"*.{ext}"
        assert sorted(map(tuple, read_table(spark, str(path)).collect())) == sorted(want)
        if sep == ",":
            assert sorted(map(tuple, read_folder(spark, str(tmp_path)).drop("__source").collect())) == sorted(want)


def test_a_large_file_with_one_open_quote_is_read_by_many_tasks(spark, tmp_path):
    n = 30_000
    lines = [f"{i},plain text of row {i},x" for i in range(n)]
    lines[70] = '70,"opened here\nand closed there",x'
    (tmp_path / "t.csv").write_text("id,text,end\n" + "\n".join(lines) + "\n")
    with blocks_of(spark, 60_000):
        for df in (read_table(spark, str(tmp_path / "t.csv")), read_csv_tolerant(spark, str(tmp_path / "t.csv"))):
            per_task = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(per_task) == n and len(per_task) >= 4 and max(per_task) < n / 2
            assert df.filter("id = 70").first()["text"] == "opened here\nand closed there"
            assert df.agg(F.sum("id"), F.max(F.length("text"))).first() == (n * (n - 1) // 2, len("opened here\nand closed there"))


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_a_quote_that_is_never_closed_ends_with_its_line(spark, tmp_path, size):
    rows = [f"{i},t{i}" for i in range(200)]
    rows[3], rows[150] = '3,"t\n3"', '150,"never closed'
    (tmp_path / "t.csv").write_text("id,text\n" + "\n".join(rows) + "\n")
    with blocks_of(spark, size):
        got = {r["id"]: r["text"] for r in read_table(spark, str(tmp_path / "t.csv")).collect()}
        assert got[3] == "t\n3" and got[151] == "t151" and got[199] == "t199" and len(got) == 200
        tolerant = {r["id"]: r["text"] for r in read_csv_tolerant(spark, str(tmp_path / "t.csv")).collect()}
        assert tolerant[3] == "t\n3" and tolerant[199] == "t199" and set(tolerant) >= set(range(200)) - {150}


def written(spark):
    """Files in the stage folders and those of shuffles and spills, with their sizes."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles())
    staged = Path(spark.conf.get("spark.checkpoint.dir")).rglob("*.parquet")
    return {str(f): Path(str(f)).stat().st_size for f in [*shuffled, *staged] if Path(str(f)).is_file()}


def test_text_of_records_is_stored_once(spark, tmp_path):
    rng = random.Random(8)
    letters = string.ascii_letters + string.digits + ".;:!?-+*/()<>"  # hard to compress
    texts = ["\n".join("".join(rng.choices(letters, k=80)) for _ in range(12)) for _ in range(1500)]
    with (tmp_path / "t.csv").open("w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([("id", "text"), *enumerate(texts)])
    size = (tmp_path / "t.csv").stat().st_size
    for read in (read_csv_tolerant, read_table):
        before = written(spark)
        with blocks_of(spark, size // 5):
            got = read(spark, str(tmp_path / "t.csv"))
            assert got.agg(F.sum("id"), F.sum(F.length("text"))).first() == (1500 * 1499 // 2, sum(map(len, texts)))
        assert sum(n for f, n in written(spark).items() if f not in before) < 1.3 * size


@pytest.mark.parametrize(("batch", "most"), [(3, 100_000), (10_000, 0), (3, 0)])
def test_records_over_batches_and_shuffled_blocks(spark, tmp_path, monkeypatch, batch, most):
    monkeypatch.setattr(records, "MOST_BLOCKS", most)
    rng, want = random.Random(batch), []
    for name in "pqr":
        text = table_text(rng, 200, ",")
        (tmp_path / f"{name}.csv").write_text(f'made for "{name}\n' * (name == "q") + text + 'k,"open\nx,y,z\n' * (name == "r"))
        want += [tuple(r) for r in csv.reader(io.StringIO(text))][1:] + [("x", "y", "z")] * (name == "r")
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, str(batch))
    try:
        with blocks_of(spark, 2500):
            got = read_folder(spark, str(tmp_path)).drop("__source").collect()
    finally:
        spark.conf.set(conf, before)
    assert sorted(tuple(r) for r in got if r["id"] != "k") == sorted(want)


def test_blocks_cut_anew_are_an_error(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n" + '1,"x\ny"\n' * 500)
    lines = text_lines(spark, [str(tmp_path / "t.csv")])
    with blocks_of(spark, 300), cut_alike(spark):
        blocks = block_states(lines, 1).withColumn("kind", F.lit(0))
    with blocks_of(spark, 200), cut_alike(spark), pytest.raises(Exception, match="other blocks"):
        quoted_records(lines, blocks)


def test_no_line_is_searched_for_a_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text("x\na,b\n1,2\n")
    assert read_csv_tolerant(spark, str(tmp_path / "t.csv"), header_lines=0).columns == ["x"]


def objects(rng, n):
    texts = ['a "quoted" {brace}', "[x], {y}", "back\\slash", "\\", "é\n\t", "", "}{", "plain"]
    return [{"id": i, "s": rng.choice(texts), "o": {"l": [1, {"z": rng.choice(texts)}], "e": {}}, "e": []} for i in range(n)]


@pytest.mark.parametrize("size", [1900, 1 << 20])
def test_lists_of_objects_equal_the_json_reader(spark, tmp_path, size):
    rng = random.Random(size)
    want = []
    for name, indent in (("p", None), ("q", 2)):
        rows = objects(rng, 150)
        want += rows
        mark = "﻿" if indent else ""
        (tmp_path / f"{name}.json").write_text(mark + json.dumps(rows, indent=indent, ensure_ascii=False) + "\n", encoding="utf-8")
    (tmp_path / "r.json").write_text(" [ ]\n")
    with blocks_of(spark, size):
        found = [json.loads(r["text"]) for r in json_objects(spark, str(tmp_path)).collect()]
        assert sorted(found, key=str) == sorted(want, key=str)
        got = read_table(spark, str(tmp_path / "*.json"))
        assert sorted((r["id"], r["s"]) for r in got.collect()) == sorted((w["id"], w["s"]) for w in want)


def test_a_large_list_is_read_by_many_tasks(spark, tmp_path):
    n = 20_000
    (tmp_path / "t.json").write_text(json.dumps([{"id": i, "text": f"row {i}"} for i in range(n)]))
    with blocks_of(spark, 60_000):
        found = json_objects(spark, str(tmp_path / "t.json"))
        per_task = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(per_task) == n and len(per_task) >= 4 and max(per_task) < n / 2
        assert read_table(spark, str(tmp_path / "t.json")).agg(F.sum("id")).first()[0] == n * (n - 1) // 2


@pytest.mark.parametrize("text", [
    '[{"a": 1} {"a": 2}]', '[{"a": 1},]', '[{"a": 1}', '[{"a": 1}}]', '[{"a": 1}] x', '[{"a": "x]', '[1, {"a": 1}]', '[{"a": 1}, 2]',
    '[{"a": oops}]', '[{"a": 1}][{"a": 2}]', "[[{}]]",
])
def test_what_is_no_list_of_objects_is_refused(spark, tmp_path, text):
    (tmp_path / "t.json").write_text(text)
    with pytest.raises(Exception, match="(?i)malformed"):
        read_table(spark, str(tmp_path / "t.json")).collect()
