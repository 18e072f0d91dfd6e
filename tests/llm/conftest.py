"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

import pytest

LONG = " ".join(f"word{i % 977} and more," for i in range(6000)) + " end."
KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, score string, text_hash string, fp string"


@pytest.fixture(scope="session")
def odd_rows():
    texts = [
        (0, "One two three four five six. Seven eight nine ten eleven twelve."), (1, None), (2, ""), (3, " \t\n "),
        (4, LONG), (4, LONG), (5, "one two three four five six. seven eight nine ten eleven twelve."), (6, "日本語のテキスト 🎉 é"),
        (7, "word"), (None, "a row without an id"), (8, "<|endoftext|> and İstanbul \x1f \xa0 ½ it's"), (9, "12 34"), (10, "word"),
    ]
    return [(i, t, "en" if t else None, "s", None if t is None else len(t), 7, "x", "y", "z") for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, KINDS).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def docs_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, docs_dir):
    return spark.read.parquet(f"{docs_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    """(doc_id, text) in ascending doc_id."""
    return sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
