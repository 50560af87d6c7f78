"""Exact and near duplicates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import chunks, spelled, split_words

try:
    from _md5 import md5  # for short words, half the time of OpenSSL's
except ImportError:
    from hashlib import md5

#: The 64 bits in six blocks; fingerprints that differ in three bits at most share three of them, so 20 keys of 31 to
#: 33 bits find every pair, and a bucket rarely holds two fingerprints that are not alike.
BLOCKS = 6


def content_hash(content: str = "content") -> Column:
    return F.md5(F.coalesce(F.col(content), F.lit("")))


def first_hashes(pages: DataFrame, order: str = "ord", content: str = "content") -> DataFrame:
    """(order, content_md5) of the first page of each content; contents themselves are not moved."""
    return pages.select(content_hash(content).alias("content_md5"), order).groupBy("content_md5").agg(F.min(order).alias(order))


def first_of_equal(pages: DataFrame, order: str = "ord", content: str = "content") -> DataFrame:
    """``pages`` with content_md5, only the first in order of each content (``order`` must differ between rows).

    The winner of each hash is found by a partial aggregation over narrow rows, so a content that repeats in a large
    part of the table sends one row from each task.
    """
    hashed = pages.withColumn("content_md5", content_hash(content))
    first = hashed.groupBy("content_md5").agg(F.min(order).alias(order))
    return hashed.join(first, ["content_md5", order], "left_semi")


def duplicate_groups(pages: DataFrame, order: str = "ord", content: str = "content") -> DataFrame:
    """(content_md5, copies, first) of each content that occurs more than once; ``duplicate_members`` lists them."""
    return pages.select(content_hash(content).alias("content_md5"), order).groupBy("content_md5").agg(F.count("*").alias("copies"), F.min(order).alias("first")).where("copies > 1")


def duplicate_members(pages: DataFrame, order: str = "ord", content: str = "content") -> DataFrame:
    """(order, content_md5, first): every page of a repeated content and the first one, a row each."""
    narrow = pages.select(content_hash(content).alias("content_md5"), order)
    return narrow.join(duplicate_groups(pages, order, content), "content_md5").select(order, "content_md5", "first")


def simhash64(terms: DataFrame, key: str = "doc_id", term: str = "term", tf: str = "tf") -> DataFrame:
    """(key, simhash bigint) from term counts: bit i is set if more of the tokens' MD5 low 64 bits have it than not.

    Each distinct term of a document is hashed once and weighs its count.  Ties leave a bit 0.  The votes are 32 sums of
    one partial aggregation, each of two bits: a document has fewer than 2^31 tokens.  Documents are never gathered.
    """
    hashed = terms.withColumn("__h", F.conv(F.substring(F.md5(term), 17, 16), 16, -10).cast("long"))
    two = F.lit((1 << 32) + 1)
    votes = [F.sum(F.col(tf) * F.shiftright("__h", i).bitwiseAND(two)) for i in range(32)]
    return _voted(hashed, key, F.sum(tf), votes)


def _voted(rows: DataFrame, key: str, words: Column, votes: list[Column]) -> DataFrame:
    """(key, simhash) of the numbers of a key's words and, for i below 32, of its words with bit i and, 2^32 times, with bit i + 32."""
    counted = rows.groupBy(key).agg(words.alias("__n"), *[v.alias(f"v{i}") for i, v in enumerate(votes)])
    # the sign of n - 2 votes is the bit; both halves move up together. 64 conditions in one expression are too long to be compiled
    above = lambda v: f"shiftrightunsigned(__n - 2 * {v}, 63)"
    listed = ", ".join(f"v{i}" for i in reversed(range(32)))
    return counted.selectExpr(key, f"aggregate(array({listed}), 0L, (a, v) -> shiftleft(a, 1) | {above(f'(v & {(1 << 32) - 1}L)')} | shiftleft({above('shiftright(v, 32)')}, 32)) AS simhash")


def hamming(a: str | Column, b: str | Column) -> Column:
    return F.bit_count((F.col(a) if isinstance(a, str) else a).bitwiseXOR(F.col(b) if isinstance(b, str) else b))


def _masks() -> list[int]:
    edges = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    blocks = [sum(1 << b for b in range(x, y)) for x, y in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in (a | b | c for a, b, c in combinations(blocks, 3))]


def fingerprint_classes(hashes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, simhash, class_id): documents of one fingerprint share a class, named by its smallest key."""
    return hashes.join(hashes.groupBy("simhash").agg(F.min(key).alias("class_id")), "simhash").select(key, "simhash", "class_id")


def near_pairs(hashes: DataFrame, radius: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, dup_id, hamming): pairs of classes whose fingerprints differ in at most ``radius`` bits (3 or fewer).

    Classes are compared by their smallest key, key < dup_id: with ``fingerprint_classes`` this is every pair of near
    documents, without expanding copies.  A pair comes out under the first key that it shares, so nothing is made
    distinct afterwards.
    """
    if radius > BLOCKS - 3:
        raise ValueError(f"radius {radius} needs more blocks")
    classes = hashes.groupBy("simhash").agg(F.min(key).alias("id"))
    masks = _masks()
    keys = F.array(*[F.struct(F.lit(k).alias("m"), F.col("simhash").bitwiseAND(F.lit(m)).alias("k")) for k, m in enumerate(masks)])
    rows = classes.select("id", "simhash", F.explode(keys).alias("b")).select("b.m", "b.k", "id", "simhash")
    a, b = rows.alias("a"), rows.alias("b")
    apart = F.col("a.simhash").bitwiseXOR(F.col("b.simhash"))
    shared_first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(k)) for k, m in enumerate(masks)])
    joined = a.join(b, (F.col("a.m") == F.col("b.m")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.id") < F.col("b.id")) & (F.bit_count(apart) <= radius) & (shared_first == F.col("a.m")))
    return joined.select(F.col("a.id").alias(key), F.col("b.id").alias("dup_id"), F.bit_count(apart).alias("hamming"))


#: Bytes of texts whose words are counted at a time.
VOTED = 1 << 22
#: Words that are counted in bytes before they are added to wider numbers.
PIECE = 255
#: Pieces whose words' bits are laid out at a time.
PIECES = 256


def _votes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, words, votes) of each text that has a word; votes are the numbers of its words with bits 0 to 63."""
    words, begins = split_words(texts)
    lengths = np.diff(begins)
    some = np.flatnonzero(lengths)
    if not len(some):
        return some, lengths[some], np.zeros((0, 64), np.int64)
    coded = words.dictionary_encode()
    hashes = np.frombuffer(b"".join([md5(w).digest() for w in spelled(coded.dictionary)]), ">u8")[1::2].astype("<u8")
    # a word's row has a byte for each bit, and eight bytes are added at once
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    codes = coded.indices.to_numpy()
    pieces = -(-lengths[some] // PIECE)
    ends = np.cumsum(pieces)
    at = np.repeat(begins[some], pieces) + (np.arange(ends[-1]) - np.repeat(ends - pieces, pieces)) * PIECE
    stops, counted = np.append(at[1:], len(codes)), np.empty((len(at), 8), np.uint64)
    for k in range(0, len(at), PIECES):
        each = bits[codes[at[k] : stops[k : k + PIECES][-1]]]
        counted[k : k + PIECES] = np.add.reduceat(each, at[k : k + PIECES] - at[k], axis=0)
    return some, lengths[some], np.add.reduceat(counted.view(np.uint8), ends - pieces, axis=0, dtype=np.int64)


def text_simhash(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``simhash64`` of the unstemmed words of plain texts; texts without a word have none.

    Words are found, hashed and counted where their texts lie, all words of a piece of 4 MB at once and each distinct
    one hashed once; a text's votes are a row.
    """
    names = ["__n", *(f"v{i}" for i in range(32))]
    schema = T.StructType([docs.schema[key], *(T.StructField(n, T.LongType()) for n in names)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, VOTED):
                at, n, bits = _votes(part.column(text))
                two = bits[:, :32] + (bits[:, 32:] << 32)
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(at)), pa.array(n), *(pa.array(two[:, i]) for i in range(32))], names=[key, *names])

    return _voted(docs.select(key, text).mapInArrow(count, schema), key, F.sum("__n"), [F.sum(n) for n in names[1:]])
