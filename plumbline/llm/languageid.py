"""Operator 9: language identification by a conditional random field over words.

The field is trained on the driver from a bounded sample of labelled documents: `per_language` of
each language, those with the smallest hash of doc_id, so the sample does not depend on how the rows
are dealt out. Prediction reads whole texts and nothing else. The document's language is the one with
the largest sum of word marginals; the score is that sum over the number of words.

Null text and text without letters is `und` with score 0, and so is every text if there is nothing to
learn from; a null doc_id counts as the empty id; null lang is never learned; repeated rows give
repeated results; an empty table gives no rows; other columns are not read, and kept but for those named like the two results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches, text_of, whole_row
from plumbline.llm.crf import Field, train

PER_LANGUAGE = 100
UNDETERMINED = "und"


def held_out() -> Column:
    """Whether a document is in the fifth that is never learned from."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """(text, lang) of the sampled documents, in a fixed order."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = labelled.select("doc_id", "lang", F.row_number().over(order).alias("n"))
    ids = [r["doc_id"] for r in ranked.filter(F.col("n") <= per_language).collect()]  # per_language each
    if not ids:
        return []
    rows = labelled.filter(F.col("doc_id").isin(ids)).select("lang", text_of().alias("text"), F.xxhash64("doc_id").alias("h"))
    ranks = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    taken = rows.withColumn("n", ranks).filter(F.col("n") <= per_language).collect()
    return [(r["text"], r["lang"]) for r in sorted(taken, key=lambda r: (r["h"], r["lang"], r["text"]))]


def predict(docs: DataFrame, field: Field | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the language and its score under `names`; all other columns of `docs` are kept."""
    schema = "lang_pred string, score double"
    shared = docs.sparkSession.sparkContext.broadcast(field)  # bounded by buckets, labels and sample

    @F.arrow_udf(schema)
    def label(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for part in texts:
            found = []
            batch = pa.record_batch([part], names=["text"])
            for some in small_batches([batch], 8 << 20):
                plain = [t or "" for t in some["text"].to_pylist()]
                found += model.predict(plain) if model else [(None, 0.0)] * len(plain)
            langs = pa.array([lang or UNDETERMINED for lang, _ in found], pa.string())
            yield pa.StructArray.from_arrays([langs, pa.array([s for _, s in found], pa.float64())], names=["lang_pred", "score"])

    kept = docs.drop(*names)
    labelled = kept.select(whole_row(kept).alias("row"), label(text_of()).alias("found"))
    return labelled.select("row.*", F.col("found.lang_pred").alias(names[0]), F.col("found.score").alias(names[1]))


def identify(
    docs: DataFrame, per_language: int = PER_LANGUAGE, names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """Trains on the documents' own labels and predicts every document."""
    return predict(docs, train(training_sample(docs, per_language)), names)
