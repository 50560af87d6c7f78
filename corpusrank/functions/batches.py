"""Texts and word lists of Arrow batches as arrays of words: what is done for every word is done for all words of a piece at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of contents that a Python worker works on at a time (or one row, if it is longer).
CHUNK = 1 << 20

#: A byte's lower case if it is an ASCII letter or digit, else 0.
_LOWER = np.zeros(256, np.uint8)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _LOWER[_c] = _c
    _LOWER[ord(chr(_c).upper())] = _c


def sizes(column: pa.Array) -> list[int]:
    """Bytes of each row's content: a text, or (about) a list of words."""
    if pa.types.is_list(column.type):
        return pc.multiply(pc.fill_null(pc.list_value_length(column), 0), 8).to_pylist()
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def chunks(batch: pa.RecordBatch, content: str, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of at most so many bytes of content, or one row."""
    start = size = 0
    for i, n in enumerate(sizes(batch.column(content))):
        if i > start and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def _layout(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, and the place where each begins (and the last ends)."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    _, ends, data = texts.buffers()
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def split_words(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """All words of some texts, as ``text.words`` has them, and the place in them where each text's begin (and the last one's end)."""
    data, ends = _layout(texts)
    low = _LOWER[data]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = low != 0
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    # a word ends with its text
    edges = ends[:-1][ends[:-1] < len(low)]
    first[edges] = inside[1:-1][edges]
    edges = ends[1:][ends[1:] > 0] - 1
    last[edges] = inside[1:-1][edges]
    starts = np.flatnonzero(first)
    places = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(np.flatnonzero(last) + 1 - starts, out=places[1:])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places.tobytes()), pa.py_buffer(low[inside[1:-1]].tobytes()))
    return words, np.searchsorted(starts, ends)


def listed_words(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The same of word lists."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return listed_words(column) if pa.types.is_list(column.type) else split_words(column)


def spelled(words: pa.Array) -> list[bytes]:
    """Words as Python's bytes; pyarrow's own way makes an object more of each."""
    _, ends, data = words.cast(pa.string()).buffers()
    if data is None:
        return [b""] * len(words)
    data, ends = data.to_pybytes(), np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
