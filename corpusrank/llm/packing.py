"""Sequence packing (operator 8): first-fit decreasing over a tournament tree, in randomised groups of documents.

Tokenising needs each text once and leaves only the pieces' positions, lengths and checksums, so no text is shuffled.
Groups are drawn from row numbers, not from keys or sources, so that no hot value gathers in one group.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import ragged, text_chunks, worker_cache

CAPACITY = 2048
#: Documents of a group, on average.
GROUP = 4096
#: Words that a worker remembers; just below the size at which their table would double.
KNOWN = 320_000
EOS = 1


#: Letters whose lower case depends on what follows or has several letters.
ODD = re.compile("[Σİ]")


def _byte_chars() -> dict[int, str]:
    """The characters that byte-level tokenizers use for bytes: printable Latin-1 as it is, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = (b for b in range(256) if b not in plain)
    return {b: chr(0x100 + k) for k, b in enumerate(other)}


BYTE_CHARS = _byte_chars()


class TournamentTree:
    """Leaves are the bins' free capacities, an inner node holds the larger of its two; finds the leftmost bin with room."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.width = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.width)

    def put(self, size: int) -> tuple[int, int]:
        """Place ``size`` in the first bin with room; returns the bin and the offset in it."""
        free, at = self.free, 1
        while at < self.width:
            at *= 2
            if free[at] < size:
                at += 1
        left = free[at]
        free[at] = left - size
        leaf = at - self.width
        at >>= 1
        while at:
            most = max(free[2 * at], free[2 * at + 1])
            if free[at] == most:
                break
            free[at] = most
            at >>= 1
        return leaf, left


def first_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece: longest first (ties in given order), each into the first bin with room."""
    order = np.argsort(-lengths, kind="stable")
    tree = TournamentTree(max(1, len(lengths)), capacity)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order.tolist():
        bins[i], left = tree.put(int(lengths[i]))
        offsets[i] = capacity - left
    return bins, offsets


class _Growing:
    """An array that is appended to."""

    def __init__(self, dtype: type) -> None:
        self.data, self.used = np.zeros(1024, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        to = self.used + len(values)
        if to > len(self.data):
            self.data = np.r_[self.data, np.zeros(max(to, len(self.data)), self.data.dtype)]
        self.data[self.used : to] = values
        self.used = to


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space and never merges across it; remembers words, a bounded number."""

    def __init__(self, tokenizer: str) -> None:
        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.marks = {m: self.tokenizer.encode(m.decode(), add_special_tokens=False).ids for m in (b",", b".")}
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.sizes, self.flat = _Growing(np.int64), _Growing(np.int32), _Growing(np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text.

        Cutting at ASCII white space first changes nothing: no pattern, mark or merge crosses it.  Nor does lower-casing
        A-Z, which the tokenizer does itself, unless a special token's name ("<|...|>") could come about.
        """
        if len(self.known) > KNOWN:
            self.forget()
        words, counts = [], []
        for t in texts:
            raw = t.encode("utf-8", "surrogatepass")
            w = (raw if b"<|" in raw else raw.lower()).split()
            words += w
            counts.append(len(w))
        codes = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            lost = [words[i] for i in missing.tolist()]
            new = list(dict.fromkeys(lost))
            ids = self._ids(new)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.starts.extend(self.flat.used + np.cumsum(sizes) - sizes)
            self.sizes.extend(sizes)
            self.flat.extend(np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            codes[missing] = np.fromiter(map(self.known.__getitem__, lost), np.int64, len(lost))
        lengths = self.sizes.data[codes]
        ids = self.flat.data[ragged(self.starts.data[codes], lengths)]
        upto = np.r_[0, np.cumsum(lengths, dtype=np.int64)][np.cumsum(counts, dtype=np.int64)]
        return np.split(ids, upto[:-1]) if len(texts) else []


    def _ids(self, words: list[bytes]) -> list[list[int]]:
        """Ids of distinct words.

        A word of letters alone is one piece, so the tokenizer's merges are asked for it directly; a comma or full stop
        after it is a piece of its own.  All other words go through the whole tokenizer.
        """
        merges, out, rest = self.tokenizer.model.tokenize, [], []
        for k, word in enumerate(words):
            mark = word[-1:] if word.endswith((b",", b".")) else b""
            letters = word[:-1] if mark else word
            if letters.isalpha():
                own = letters.lower().decode()
            else:
                text = letters.decode("utf-8", "replace")
                own = text.lower().encode().decode("latin-1").translate(BYTE_CHARS) if text.isalpha() and is_normalized("NFC", text) and not ODD.search(text) else ""
            if own:
                out.append([t.id for t in merges(own)] + (self.marks[mark] if mark else []))
            else:
                out.append([])
                rest.append(k)
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([words[k].decode("utf-8", "replace") for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out


def _encoder(tokenizer: str) -> WordEncoder:
    """One for each Python worker, so that words stay known between tasks; tasks are the unit of parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    cache = worker_cache("packing")
    if tokenizer not in cache:
        cache[tokenizer] = WordEncoder(tokenizer)
    return cache[tokenizer]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, text: str = "text", row: str = "doc_id") -> DataFrame:
    """(row, start, length, crc, tokens, uid): each document's ids and the end id 1, cut into pieces of ``capacity`` at most.

    A null or empty text is the end id alone.  uid numbers the rows read.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())  # the vocabulary: a size that data does not change

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for part, texts in text_chunks(batches, chars=1 << 19, owner="packing"):
            which, start, length, crc, total = [], [], [], [], []
            for i, ids in enumerate(encoder.encode(texts)):
                ids = np.append(ids, np.uint32(EOS)).astype("<u4")
                for at in range(0, len(ids), capacity):
                    piece = ids[at : at + capacity]
                    which.append(i)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
            take = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("row").take(take), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), part.column("uid").take(take)], names=["row", "start", "length", "crc", "tokens", "uid"])

    rows = docs.select(F.col(row).cast("long").alias("row"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("uid"))
    return rows.mapInArrow(run, "row long, start long, length long, crc long, tokens long, uid long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, group: int = GROUP, seed: int = 0, text: str = "text", row: str = "doc_id") -> DataFrame:
    """A row for each piece: (row, start, length, crc, tokens, sequence_id, offset), pieces of a sequence gapless from 0.

    Documents fall into ceil(rows / group) groups at random (by ``seed``); a group's pieces are packed together, so a
    task holds the lengths of a few thousand documents whatever the table's size.  Every row is packed, repeated rows
    and null ids too; a null or empty text is one piece, of the closing id alone; a text of any length is encoded whole
    and cut into pieces of ``capacity``, of which the task that packs them holds the lengths.  Pieces of equal length are
    placed in the order of rows.  Other columns are not read; an empty table gives none.
    """
    groups = max(1, -(-docs.count() // group))
    pieces = token_pieces(docs, tokenizer_path, capacity, text, row).withColumn("g", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(groups)))

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["uid", "start"], kind="stable", ignore_index=True)
        bins, part["offset"] = first_fit_decreasing(part["length"].to_numpy(), capacity)
        part["sequence_id"] = part["g"] * (1 << 32) + bins
        return part[["row", "start", "length", "crc", "tokens", "sequence_id", "offset"]]

    return pieces.groupBy("g").applyInPandas(fill, "row long, start long, length long, crc long, tokens long, sequence_id long, offset long")
