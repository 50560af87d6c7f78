"""The queries opN_<name> of this subpackage and the SQL that DuckDB can check them by."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bpe, chat, fingerprint, html_text, langid, licenses, packing, pii, simhash, topk
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document: 3-word shingles, links at 2 or fewer bits."""
    found = simhash.near_classes(table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents")).withColumnRenamed("row", "doc_id")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes that they decode to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.bpe_encode(table(spark, sf_dir, "documents"), ranks)
    decoded = bpe.bpe_decode(encoded, ranks)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return decoded.select(F.col("row").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("bytes"), 256).alias("decoded_sha256"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer inner products for each vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s
)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 10
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence text, header and notice in the documents."""
    return licenses.scan_licences(table(spark, sf_dir, "documents")).withColumnRenamed("row", "doc_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, by code length."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", langid.is_held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's repair and what it adds to its rendered conversation."""
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces and their places in sequences of 2048 ids."""
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(F.col("row").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), "sequence_id", "offset")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page, laid out."""
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base formats, and all spans."""
    found = pii.find_pii(table(spark, sf_dir, "documents")).drop("redacted")

    def listed(spans: str) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


QUERIES: dict[str, Query] = {
    "pipeline": corpus_pipeline.run,
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_exact_topk": op4_exact_topk,
    "op5_license_scan": op5_license_scan,
    "op6_language_id": op6_language_id,
    "op7_chat_format": op7_chat_format,
    "op8_packing": op8_packing,
    "op9_html_text": op9_html_text,
    "op10_pii": op10_pii,
}
SQL: dict[str, str] = ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}) | {"op4_exact_topk": OP4_SQL, "op5_license_scan": licenses.scan_sql()}
