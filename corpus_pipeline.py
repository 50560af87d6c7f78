"""A training corpus from the table documents: language ID, near-duplicate removal, redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on every document that the stage before it kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrank.llm import bloom, langid, packing, pii, simhash
from corpusrank.llm.common import checkpoint, column, columns, own_names, release, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Set lang to the language that the text is in; documents in no learned language go.

    What goes: null texts, texts without a letter, and texts whose code is far longer than those of the learned
    languages take (``langid.accepted``).  With no labelled document there is no language to reject by, and all stay
    as they are.  Texts are read whole, of any length; repeated rows and further columns, of any name, are kept as they
    are; of two languages with equal codes the first by name is taken; an empty table gives an empty result.
    """
    model = langid.train(docs)
    if not model.langs:
        return docs
    pred, _, bits = own_names(docs.columns, "lang_pred", "score", "bits_per_byte")
    found = langid.identify(docs, model, keep=docs.columns).where(langid.accepted(model, pred, bits))
    return found.select(*[column(pred).alias(c) if c == "lang" else column(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each class of near-duplicates (five words, similarity 0.8 or more).

    Null, empty and blank texts are one class.  Of rows of one class and id one stays, rows without an id only if their
    class has no other.  Texts are compared whole, of any length; further columns, of any name, are kept as they are;
    an empty table gives an empty result.
    """
    (number,) = own_names(docs.columns, "row")
    numbered = checkpoint(docs.withColumn(number, F.monotonically_increasing_id()))  # written, as each scan would number anew
    classes = simhash.near_duplicates(numbered, words=5, similarity=0.8, row=number)
    ids = numbered.select(column(number).alias("__row"), F.col("doc_id").alias("__id")).join(classes.withColumnRenamed("row", "__row"), "__row")
    first = ids.groupBy("component").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__row"))["__row"].alias("__row"))
    others = checkpoint(ids.select("__row").join(first.select("__row"), "__row", "left_anti"))  # by row, as a class may be large
    release(classes)
    return bloom.keep_others(numbered, others, number).select(*columns(docs))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and secrets by their kind; n_chars follows the text.

    Null texts stay null with the n_chars that they have, texts without a span stay as they are.  Texts are searched
    whole, of any length; where spans overlap, one mark stands for all; repeated rows and further columns, of any name,
    are kept as they are; an empty table gives an empty result.
    """
    found = pii.find_pii(docs, keep=docs.columns)
    clean = column(own_names(docs.columns, "base", "spans", "redacted")[2])
    length = F.when(clean.isNull(), F.col("n_chars")).otherwise(F.length(clean).cast("long"))
    new = {"text": clean.alias("text"), "n_chars": length.alias("n_chars")}
    return found.select(*[new.get(c, column(c)) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of 2048 ids.

    Null and empty texts are one piece, of the closing id alone; texts of any length are cut over sequences; repeated
    rows are packed each, rows without an id too; further columns are not read; an empty table gives an empty result.
    """
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(F.col("row").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("redact_pii", redact_pii),
    ("pack", pack),
]

#: SQL cannot express these stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet to the cluster's shared folder, read again, and deleted after the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, checkpoint(stage(spark, docs, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
