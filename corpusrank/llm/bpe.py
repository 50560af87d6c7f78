"""Byte-level BPE (operator 3): encoding by length-bucketed matrices, decoding by one gather.

Text is cut by the tokenizer's pattern; the distinct pieces that a task has not met yet are laid out in padded
matrices of similar lengths.  In each round every row merges its leftmost pair of least rank; pair ranks come from a
hash table over (left id, right id), two of which change in a merge; rows close up after the merge, and finished rows
leave the matrix.  Pieces beyond ``WIDEST`` bytes (a run without a cut) would make the matrix quadratic and are merged
one at a time through a heap, with the same rule.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged, text_chunks, worker_cache
from .hashindex import HashIndex

NONE = np.int32(2**31 - 1)
WIDEST = 1024
#: Cells of a matrix, pieces remembered by a task.
CELLS, KNOWN = 1 << 20, 1 << 18


class ByteBPE:
    """Merge ranks of a vocabulary in the ``base64 rank`` line format; a token's id is its rank."""

    def __init__(self, ranks: bytes) -> None:
        of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        size = max(of.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in of.items():
            self.tokens[rank] = token
        self.single = np.array([of[bytes([b])] for b in range(256)], np.int32)
        pairs = {(of[t[:k]] << 32) | of[t[k:]]: r for t, r in of.items() for k in range(1, len(t)) if t[:k] in of and t[k:] in of}
        self.index = HashIndex(np.fromiter(pairs.keys(), np.uint64, len(pairs)))
        self.merged = np.r_[np.fromiter(pairs.values(), np.int32, len(pairs)), NONE]
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merged pairs, NONE where there is no such merge or an end is missing (-1)."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        return np.where((left >= 0) & (right >= 0), self.merged[self.index.find(key)], NONE)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(lengths, kind="stable")
        at = int(np.searchsorted(lengths[order], 1))
        while at < len(order):
            width = int(lengths[order[at]])
            if width > WIDEST:
                for i in order[at:]:
                    out[i] = self._by_heap(pieces[i])
                break
            width = min(WIDEST, 1 << (width - 1).bit_length())
            to = min(int(np.searchsorted(lengths[order], width, "right")), at + max(1, CELLS // width))
            self._by_matrix([pieces[i] for i in order[at:to]], order[at:to], width, out)
            at = to
        return out

    def _by_matrix(self, pieces: list[bytes], where: np.ndarray, width: int, out: list[np.ndarray]) -> None:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.where(np.arange(width) < size[:, None], self.single[raw], np.int32(-1))
        ranks = np.full((len(pieces), width), NONE)
        if width > 1:
            ranks[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
        while len(where):
            rows = np.arange(len(where))
            at = ranks.argmin(1)
            best = ranks[rows, at]
            done = best == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[where[i]] = ids[i, : size[i]].copy()
                go = ~done
                where, size, ids, ranks, at, best = where[go], size[go], ids[go], ranks[go], at[go], best[go]
                rows = np.arange(len(where))
                if not len(where):
                    break
            ids[rows, at] = best
            width = int(size.max())
            cols = np.arange(width)
            shift = np.minimum(cols + (cols > at[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, shift, 1), np.take_along_axis(ranks, np.minimum(cols + (cols >= at[:, None]), width - 1), 1)
            size -= 1
            ids[rows, size] = -1
            ranks[rows, np.maximum(size - 1, 0)] = NONE
            ranks[rows, size] = NONE
            right = ids[rows, np.minimum(at + 1, width - 1)]
            ranks[rows, at] = np.where(at + 1 < size, self.rank(best, right), NONE)
            has = at > 0
            ranks[rows[has], at[has] - 1] = self.rank(ids[rows[has], at[has] - 1], best[has])

    def _by_heap(self, piece: bytes) -> np.ndarray:
        ids = self.single[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        first = self.rank(ids[:-1], ids[1:])
        ids, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r != NONE]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            r = int(self.rank(np.array([ids[i]]), np.array([ids[j]]))[0])
            if r != NONE:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([x for x in ids if x >= 0], np.int32)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes (uint8) that the ids stand for, in a row."""
        return self.bytes[ragged(self.starts[ids], self.lengths[ids])]


class Encoder:
    """Encodes texts; remembers the ids of pieces between calls (a bounded number of them)."""

    def __init__(self, bpe: ByteBPE, pattern: str) -> None:
        self.bpe, self.cut = bpe, regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        if len(self.known) > KNOWN:
            self.forget()
        pieces, counts = [], []
        for t in texts:
            p = self.cut(t)
            pieces += p
            counts.append(len(p))
        codes = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            new = list(dict.fromkeys([pieces[i] for i in missing.tolist()]))
            ids = self.bpe.encode_pieces([p.encode("utf-8", "surrogatepass") for p in new])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(sizes) - sizes]
            self.sizes, self.flat = np.r_[self.sizes, sizes], np.concatenate([self.flat, *ids])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            codes[missing] = [self.known[pieces[i]] for i in missing.tolist()]
        ids = self.flat[ragged(self.starts[codes], self.sizes[codes])]
        upto = np.r_[0, np.cumsum(self.sizes[codes])][np.r_[0, np.cumsum(counts, dtype=np.int64)]]
        return ids, np.diff(upto)


def _model(ranks: bytes) -> ByteBPE:
    cache = worker_cache("bpe")
    if ranks not in cache:
        cache[ranks] = ByteBPE(ranks)
    return cache[ranks]


def read_ranks(path: str) -> bytes:
    """The vocabulary file, read once on the driver and broadcast: its size is a property of the tokenizer, not of the data."""
    with open(path, "rb") as file:
        return file.read()


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", row: str = "doc_id") -> DataFrame:
    """(row, ids array<int>) for every row of ``docs``: whole texts, each match of ``pattern`` separately, no special tokens.

    A null or empty text has no ids.  Repeated rows and null row values are kept; other columns are not read.  A text of
    any length is encoded whole, half a million bytes of texts (or one longer text) at a time.  An empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_model(shared.value), pattern)
        for part, texts in text_chunks(batches, chars=1 << 19, owner="bpe"):
            ids, sizes = encoder.encode(texts)
            offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["row", "ids"])

    return docs.select(F.col(row).cast("long").alias("row"), F.col(text).cast("string").alias("text")).mapInArrow(run, "row long, ids array<int>")


def bpe_decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(row, ids) -> (row, ids, bytes): the bytes that each row's ids stand for.  Null ids count as none; an empty table gives an empty result."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column("ids")
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ends = np.r_[0, np.cumsum(bpe.lengths[ids])][np.r_[0, np.cumsum(sizes, dtype=np.int64)]]
                data = bpe.decode(ids)
                column = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([part.column("row"), lists, column.cast(pa.binary())], names=["row", "ids", "bytes"])

    return encoded.mapInArrow(run, "row long, ids array<int>, bytes binary")


