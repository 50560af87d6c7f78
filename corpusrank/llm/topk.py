"""Exact top-k by inner product (operator 4): three phases with a uniform threshold.

A score is a sum over ``slices`` ranges of components.  (1) Every task scores each of its rows on one slice, by turns,
lists each query's leaders there, and sends the best of their whole scores; the k-th of all that were sent is a cutoff
T that k rows reach.  (2) T is broadcast; a row that reaches T has a slice with at least T / slices, so each task
collects the rows with such a slice (those whose norm cannot reach that much there are not even multiplied), drops
those whose upper bound stays below T, and (3) resolves the remaining scores exactly.  Each task sends at most k rows
a query, so a value that repeats in many rows costs nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Bytes of queries broadcast at a time (65,536 of 64 components).  A pass over the rows reads the table twice and multiplies
#: it with all of them, so that beyond a few thousand queries a pass is bound by its arithmetic, not by reading.
BLOCK = 1 << 25
CELLS = 1 << 20
SCALE = 1024
#: Components up to sqrt(WHOLE / dimension) are scored in 64 bits, larger ones by long integers.
WHOLE = 1 << 57
LEAST, MOST = -(1 << 63) + 1, (1 << 63) - 1


def integer_vectors(ids: pa.Array, vectors: pa.Array) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], dict[int, list[tuple[int, np.ndarray]]]]:
    """Dimension -> (ids, floor(1024 * component) as float64 of whole numbers), and the same as long integers for rows with larger components.

    Without nulls and non-finite components.
    """
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.r_[0, np.cumsum(~np.isfinite(values))]
    ends = np.cumsum(sizes)
    keep = vectors.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - sizes])
    number = ids.fill_null(0).to_numpy(zero_copy_only=False)
    out, wide = {}, {}
    for d in np.unique(sizes[keep]).tolist():
        rows = np.flatnonzero(keep & (sizes == d))
        given = values[(ends - sizes)[rows][:, None] + np.arange(d)].reshape(len(rows), d)
        fits = np.abs(given).max(axis=1, initial=0) < (WHOLE / max(d, 1)) ** 0.5 / SCALE - 1
        out[d] = number[rows[fits]], np.floor(SCALE * given[fits])
        if not fits.all():
            wide[d] = [(int(number[rows[i]]), _long_integers(given[i])) for i in np.flatnonzero(~fits)]
    return out, wide


def _long_integers(values: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of each component as a Python integer."""
    ratios = [v.as_integer_ratio() for v in values.tolist()]
    return np.array([SCALE * a // b for a, b in ratios] or [], object)


def products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products as int64: by floating point while that is exact, by integers beyond."""
    most = (np.abs(rows).max(initial=0)) * (np.abs(queries).max(initial=0)) * max(1, rows.shape[1])
    if most < 2**53:
        return (rows @ queries.T).astype(np.int64)
    return rows.astype(np.int64) @ queries.astype(np.int64).T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of ``scores`` (ties to the smaller id); both arrays are [queries, entries]."""
    if scores.shape[1] > 4 * k:  # all that tie with the k-th stay
        kth = np.partition(scores, -k, axis=1)[:, -k]
        width = int((scores >= kth[:, None]).sum(1).max())
        if width < scores.shape[1] // 2:
            top = np.argsort(scores < kth[:, None], axis=1, kind="stable")[:, :width]
            scores, ids = np.take_along_axis(scores, top, 1), np.take_along_axis(ids, top, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


class _Lists:
    """Running lists of the k best of each query."""

    def __init__(self, names: np.ndarray, k: int) -> None:
        self.names, self.k = names, k
        self.scores, self.ids = np.full((len(names), k), LEAST, np.int64), np.zeros((len(names), k), np.int64)

    def add(self, own: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        self.scores[own], self.ids[own] = _best(np.concatenate([self.scores[own], scores], 1), np.concatenate([self.ids[own], ids], 1), self.k)

    def add_pairs(self, own: slice, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Add (query within ``own``, id, score) entries, any number for each query."""
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        fits = place < self.k
        scores, found = np.full(self.scores[own].shape, LEAST, np.int64), np.zeros(self.ids[own].shape, np.int64)
        scores[query[fits], place[fits]], found[query[fits], place[fits]] = score[fits], ids[fits]
        self.add(own, scores, found)

    def rows(self) -> pa.RecordBatch:
        q, r = np.nonzero(self.scores > LEAST)
        return pa.RecordBatch.from_arrays([pa.array(self.names[q]), pa.array(self.ids[q, r]), pa.array(self.scores[q, r])], names=["query_id", "vec_id", "score"])


def _resolve(rows: np.ndarray, queries: np.ndarray, r: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whole scores of the pairs (rows[r], queries[q])."""
    score = np.empty(len(q), np.int64)
    for at in range(0, len(q), CELLS // 64):
        s = slice(at, at + CELLS // 64)
        score[s] = np.einsum("ij,ij->i", rows[r[s]].astype(np.int64), queries[q[s]].astype(np.int64))
    return score


def _local_lists(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, cut: slice, own: slice, lists: _Lists) -> None:
    """Phase 1: whole scores of the rows that lead in one slice; nothing else is scored whole."""
    part = products(rows[:, cut], queries[:, cut]).T
    n = min(lists.k + 1, len(ids))
    lead = np.argpartition(-part, n - 1, axis=1)[:, :n]
    q, r = np.repeat(np.arange(len(queries)), n), lead.ravel()
    scores = _resolve(rows, queries, r, q).reshape(-1, n)
    scores[ids[lead] == lists.names[own][:, None]] = LEAST
    lists.add(own, scores, ids[lead])


def _above(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, cuts: list[slice], cutoff: np.ndarray, own: slice, lists: _Lists) -> tuple[int, int]:
    """Phases 2 and 3: rows with a slice of at least cutoff / slices, pruned by their upper bound, then scored exactly.

    Returns how many (row, query) products of a slice were made, and how many whole scores.
    """
    m, floor, made = len(cuts), cutoff[:, None], 0
    known = np.zeros((len(queries), len(ids)), np.int64)
    seen = np.zeros(known.shape, np.int8)
    for c in cuts:
        x, q = rows[:, c], queries[:, c]
        longest = np.sqrt(np.einsum("ij,ij->i", q, q)) * (1 + 1e-9)
        if (cutoff > 0).all():  # |row| |query| bounds a product
            needed = (cutoff / m / np.maximum(longest, 1e-300)).min()
            at = np.flatnonzero(np.sqrt(np.einsum("ij,ij->i", x, x)) * (1 + 1e-9) >= needed)
        else:
            at = np.arange(len(ids))
        if not len(at):
            continue
        every = len(at) == len(ids)
        part = products(x if every else x[at], q).T
        made += part.size
        enough = part * m >= floor
        part[~enough] = 0
        if every:
            known += part
            seen += enough
        else:
            known[:, at] += part
            seen[:, at] += enough
    bound = known * m + (m - seen) * floor
    q, r = np.nonzero((seen > 0) & (bound >= floor * m) & (ids[None, :] != lists.names[own][:, None]))
    if len(q):
        score = _resolve(rows, queries, r, q)
        ok = score >= cutoff[q]
        lists.add_pairs(own, q[ok], ids[r[ok]], score[ok])
    return made, len(q)


def _wide_pairs(rows: list[tuple[int, np.ndarray]], queries: list[tuple[int, np.ndarray]], lists: _Lists, place: dict[int, int]) -> None:
    """All scores of rows and queries as long integers; what leaves 64 bits becomes the last number within."""
    for name, q in queries:
        found = [(i, max(LEAST + 1, min(MOST, int(x.dot(q)) if len(q) else 0))) for i, x in rows if i != name]
        if found:
            at = slice(place[name], place[name] + 1)
            ids, scores = (np.array(v, np.int64) for v in zip(*found, strict=True))
            lists.add_pairs(at, np.zeros(len(ids), np.int64), ids, scores)


class _Queries:
    """The queries of one dimension: those that fit in 64 bits, then the wide ones."""

    def __init__(self, names: np.ndarray, whole: np.ndarray, wide: list[tuple[int, np.ndarray]]) -> None:
        self.names, self.whole, self.wide = np.concatenate([names, np.array([n for n, _ in wide], np.int64)]), whole, wide
        self.place = {n: i for i, n in enumerate(self.names.tolist())}


def _scan(batches: Iterator[pa.RecordBatch], of: dict[int, _Queries], k: int, slices: int, cutoff: dict[int, int] | None) -> Iterator[pa.RecordBatch]:
    """A task's lists: those of phase 1, or with ``cutoff`` those of phases 2 and 3."""
    lists = {d: _Lists(q.names, k) for d, q in of.items()}
    limit = {d: np.array([cutoff.get(n, -WHOLE - 1) for n in q.names.tolist()], np.int64) for d, q in of.items()} if cutoff is not None else {}
    turn = 0
    for batch in batches:
        fits, wide = integer_vectors(batch.column("vec_id"), batch.column("embedding"))
        for d, (ids, x) in fits.items():
            if d not in of:
                continue
            held, m = of[d], max(1, min(slices, d))
            cuts = [slice(d * i // m, d * (i + 1) // m) for i in range(m)]
            step = max(1024, CELLS // max(1, len(held.whole)))
            some = max(1, CELLS // step)
            for at in range(0, len(ids), step):
                own_x, own_ids = x[at : at + step], ids[at : at + step]
                for first in range(0, len(held.whole), some):
                    own = slice(first, min(first + some, len(held.whole)))
                    if cutoff is None:
                        _local_lists(own_x, own_ids, held.whole[own], cuts[turn % m], own, lists[d])
                    else:
                        _above(own_x, own_ids, held.whole[own], cuts, limit[d][own], own, lists[d])
                turn += 1
            if held.wide and cutoff is not None:
                _wide_pairs([(int(i), v.astype(np.int64).astype(object)) for i, v in zip(ids, x, strict=True)], held.wide, lists[d], held.place)
        if cutoff is not None:
            for d, rows in wide.items():
                if d in of:
                    held = of[d]
                    every = [*((int(n), v.astype(np.int64).astype(object)) for n, v in zip(held.names, held.whole, strict=False)), *held.wide]
                    _wide_pairs(rows, every, lists[d], held.place)
    for own in lists.values():
        yield own.rows()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, slices: int = 4, block: int = BLOCK, vec: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over all rows of ``vectors`` but its own id.

    Components become floor(1024 * x).  Ties go to the smaller vec_id; fewer candidates give fewer rows.  Rows with a
    null id or vector, or with null or non-finite components, take no part; vectors are compared with queries of their
    own dimension.  Repeated candidate rows count each; of repeated query ids the least vector counts, once.  A score
    beyond 64 bits becomes the largest or least number within.  Other columns are not read; an empty table gives an
    empty result.

    Queries are broadcast in blocks of ``block`` bytes; the lists of a block are written before the next one comes.
    """
    spark = vectors.sparkSession
    valid = f"`{vec}` is not null and `{embedding}` is not null and forall(`{embedding}`, x -> x is not null and abs(x) < double('infinity'))"
    rows = vectors.where(valid).select(F.col(vec).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    picked = queries.where(valid).select(F.col(vec).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    weight = picked.agg(F.sum(F.size("embedding") + 1).alias("n")).first()["n"] or 0
    blocks = max(1, -(-8 * weight // block))
    if blocks > 1:
        picked = checkpoint(picked)
    schema, order, parts = "query_id long, vec_id long, score long", Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"), []
    for b in range(blocks):
        held = picked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        fits, wide = integer_vectors(held.column("vec_id").combine_chunks(), held.column("embedding").combine_chunks()) if held.num_rows else ({}, {})
        shared = spark.sparkContext.broadcast({d: _Queries(names, whole, wide.get(d, [])) for d, (names, whole) in fits.items()})

        def scan(cutoff: dict[int, int] | None, shared=shared) -> DataFrame:
            sent = spark.sparkContext.broadcast(cutoff)  # a number for each query of the block
            return rows.mapInArrow(lambda batches: _scan(batches, shared.value, k, slices, sent.value), schema)

        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        kth = scan(None).withColumn("place", place).where(F.col("place") == k).select("query_id", "score")
        found = scan({r[0]: r[1] for r in kth.collect()})
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        parts.append(best if blocks == 1 else checkpoint(best))
    return reduce(DataFrame.unionByName, parts)
