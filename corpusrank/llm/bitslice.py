"""Hamming search over bit planes: 64 fingerprints are compared with a query at a time.

A block holds 64 fingerprints vertically: word i has bit i of each of them, one lane per fingerprint.  A query's
differences in bit i are one XOR; a carry-save counter of a few words adds them to 64 distances at once; as soon as
every lane of a block exceeds the radius, the (query, block) pair is abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
ZERO = np.uint64(0)
#: Bits added between two looks at which pairs can be abandoned.
STRIDE = 8
#: (query, block) pairs held at a time.
PAIRS = 1 << 15


def planes(fps: np.ndarray) -> np.ndarray:
    """uint64[n] -> uint64[ceil(n / 64), 64]: bit planes of each block; lanes beyond n are zero."""
    n = len(fps)
    padded = np.zeros(-(-n // 64) * 64, "<u8")
    padded[:n] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    turned = np.ascontiguousarray(bits.reshape(-1, 64, 64).transpose(0, 2, 1))
    return np.packbits(turned, axis=2, bitorder="little").view("<u8").reshape(-1, 64).astype(np.uint64)


def _beyond(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is larger than the radius."""
    above, same = np.zeros_like(count[0]), np.full_like(count[0], ALL)
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            same &= count[k]
        else:
            above |= same & count[k]
            same &= ~count[k]
    return above


def near_lanes(queries: np.ndarray, sliced: np.ndarray, blocks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For query i against block ``blocks[i]``: the pairs with a lane within the radius, and their lanes as a bit mask."""
    alive = np.arange(len(queries))
    count = [np.zeros(len(queries), np.uint64) for _ in range((radius + 1).bit_length())]
    over = np.zeros(len(queries), np.uint64)
    for bit in range(64):
        words = sliced[blocks[alive], bit]
        carry = words ^ np.where(queries[alive] >> np.uint64(bit) & np.uint64(1), ALL, ZERO)
        for k in range(len(count)):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if bit % STRIDE == STRIDE - 1:
            keep = (over | _beyond(count, radius)) != ALL
            if not keep.all():
                alive, over, count = alive[keep], over[keep], [c[keep] for c in count]
                if not len(alive):
                    break
    return alive, ~(over | _beyond(count, radius)) if len(alive) else np.zeros(0, np.uint64)


def near_pairs(fps: np.ndarray, ends: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j < ends[i], whose fingerprints differ in at most ``radius`` bits, in pieces.

    ``fps`` are uint64, sorted by bucket; ``ends[i]`` is where the bucket of i ends.
    """
    n = len(fps)
    sliced = planes(fps)
    first = np.arange(n) // 64
    spans = np.maximum((ends - 1) // 64 - first + 1, 0)
    spans[ends - np.arange(n) < 2] = 0
    upto = np.cumsum(spans)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        own = np.repeat(np.arange(at, to), spans[at:to])
        if len(own):
            begin = upto[at:to] - spans[at:to] - (upto[at - 1] if at else 0)
            blocks = np.arange(len(own)) - np.repeat(begin, spans[at:to]) + first[own]
            pair, lanes = near_lanes(fps[own], sliced, blocks, radius)
            if len(pair):
                row, lane = np.nonzero(np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                i, j = own[pair[row]], blocks[pair[row]] * 64 + lane
                ok = (j > i) & (j < ends[i])
                if ok.any():
                    yield i[ok], j[ok]
        at = to


def hook(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of a[i] and b[i] for all i, in place; a label is the smallest index of its set after ``settle``."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        settle(labels)


def span(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Like ``hook``; returns which of the pairs made the unions, at most one for each that was left to make."""
    used, left = [np.zeros(0, np.int64)], np.arange(len(a))
    while True:
        x, y = labels[a[left]], labels[b[left]]
        apart = x != y
        left, high, low = left[apart], np.maximum(x, y)[apart], np.minimum(x, y)[apart]
        if not len(left):
            return np.concatenate(used)
        own, first = np.unique(high, return_index=True)
        labels[own] = low[first]
        settle(labels)
        used.append(left[first])


def settle(labels: np.ndarray) -> None:
    while not np.array_equal(deeper := labels[labels], labels):
        labels[:] = deeper
