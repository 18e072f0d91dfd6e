"""The registered queries of the operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.registry import table
from plumbline.llm import bitpack, bloomdiff, bytebpe, chat, impact, languageid, negatives, packing, piecebpe, prefixtrie, private, sharding, simhash
from plumbline.llm.common import text_of
from plumbline.operators.durable import stage_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


@register
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sharded = sharding.shard(docs, "doc_id", 16)
    size = F.octet_length(text_of()).cast("bigint") + 1
    return sharded.select(
        "doc_id", size.alias("size"), F.crc32(F.encode(text_of(), "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "slot", "grown_shard",
    )


@register
def op3_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = bitpack.write_ids(docs, stage_path(spark, "ids"), public_tokenizers.path("word_bpe_49k.json"), 49_408, end_id=2)
    read = bitpack.read_ids(spark, files)
    n = (F.octet_length("ids") / 4).cast("bigint")
    return read.select("doc_id", "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@register
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.formatted(turns.unionByName(own)))


@register
def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"), k=3, budget=2)
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


@register
def op6_impact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


ORACLE["op6_impact_top_k"] = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score
  FROM usable q JOIN usable r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT * FROM ranked WHERE rank <= 10
"""


@register
def op7_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.find_private(table(spark, sf_dir, "documents"))


@register
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = piecebpe.encode(table(spark, sf_dir, "documents"), model, decoded=True)
    n = (F.octet_length("ids") / 4).cast("bigint")
    return coded.select(
        "doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


@register
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = languageid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", languageid.held_out().alias("held_out"), "lang_pred", "score")


@register
def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloomdiff.fingerprints(table(spark, sf_dir, "documents"))


@register
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bytebpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", moved), scale=256, every=100)


ORACLE["op11_hard_negatives"] = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
    CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM usable a JOIN usable r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), found AS (
  SELECT anchor_id, positive_id,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
    other_id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT * FROM found WHERE rank <= 5
"""


@register
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = prefixtrie.with_heads(table(spark, sf_dir, "conversations"), every=100, longest=6)
    return prefixtrie.trie(turns, convs).drop("turn_id", "length")


ORACLE["op13_prefix_trie"] = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS donor, xor(list_reduce(
    list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ord(CAST(conv_id AS VARCHAR)[i]) AS BIGINT)),
    lambda c, b: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)),
    4294967295), 4294967295) % 6 AS h
  FROM turns
), rebuilt AS (
  SELECT c.conv_id, 0 AS own, t.p, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.donor AND t.p <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.p, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.p > c.h
), whole AS (
  SELECT c.conv_id, coalesce(list({'role': role, 'text': text} ORDER BY own, p) FILTER (own IS NOT NULL), []) AS path
  FROM convs c LEFT JOIN rebuilt USING (conv_id) GROUP BY c.conv_id
), members AS (
  SELECT conv_id, CAST(unnest(range(0, len(path) + 1)) AS BIGINT) AS depth, path FROM whole
), nodes AS (
  SELECT path[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(path) = depth), '')) AS ends_sha256
  FROM members GROUP BY ALL
), counted AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.prefix[1:n.depth] = n.prefix) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
)
SELECT v.conv_id, v.depth, v.parent_conv_id, v.n_convs, v.n_children, count_if(u.n_children = 0) AS n_leaves,
  CAST(sum((u.n_convs - 1) * CASE WHEN u.depth = 0 THEN 0 ELSE length(u.prefix[u.depth].text) END) AS BIGINT) AS saved_tokens, v.ends_sha256
FROM counted v JOIN counted u ON u.depth >= v.depth AND u.prefix[1:v.depth] = v.prefix
GROUP BY ALL
"""
