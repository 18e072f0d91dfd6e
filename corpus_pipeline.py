"""From raw documents to packed sequences: each stage calls one of the operators in plumbline.llm.

Null columns, empty and very long texts, repeated rows, empty tables and extra columns are treated as
the operators say. Rows that a stage keeps keep all their columns; only the PII stage changes text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import languageid, packing, private, simhash
from plumbline.llm.common import free_names
from plumbline.operators.durable import materialize

SURE = 0.5
WORDS, BITS = 3, 2  # shingle length and largest distance of near copies
SEQUENCE = 4096
END_ID = 1

ORACLE_SQL = None  # a learned model, fingerprints and token ids are beyond SQL


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known: some letters, and over half of the words' weight in it.

    The model learns from these documents' own labels outside the held-out fifth.
    """
    lang, score = free_names(docs.columns, "lang_pred", "score")
    found = languageid.identify(docs, names=(lang, score))
    return found.filter((F.col(lang) != languageid.UNDETERMINED) & (F.col(score) > SURE)).drop(lang, score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each group of near copies.

    Linked are texts whose SimHash fingerprints, of shingles of three words, differ in two bits or fewer.
    """
    return simhash.keep_one(docs, WORDS, BITS)


def mask_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets and counts the characters anew."""
    masked = private.mask_private(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, SEQUENCE)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("private_data", mask_private_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each but the last written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
