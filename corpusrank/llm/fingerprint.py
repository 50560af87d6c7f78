"""Document fingerprints (operator 2) from prefix polynomial hashes.

A text's prefix arrays hold, for two bases modulo 2^31 - 1, the sums of code point * base^position.  Two prefix
entries give the hash of any span in constant time, whatever its place: span equality is one comparison, and the
longest common extension of two positions is a binary search over it.  The fingerprint is the hash of the whole text
and a sketch: the least ``SLOTS`` scrambled hashes of the text's spans of ``SPAN`` code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks

MERSENNE = (1 << 31) - 1
PRIME = np.uint64(MERSENNE)
BASES = (1_000_003_241, 1_610_612_741)
SPAN = 16
SLOTS = 64
WHOLE = 16
#: Code points worked on at a time; what stays of a text is 8 bytes a code point, and as much again for the powers.
CHUNK = 1 << 18


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 by folding; x is below 2^62."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - PRIME, x)


class Powers:
    """base^i and base^-i modulo 2^31 - 1, extended when a longer text comes."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, np.uint32), np.ones(1, np.uint32)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = len(self.up)
            step = pow(self.base, size, int(PRIME))
            self.up = np.r_[self.up, _times(self.up[: n - size], step)]
            self.down = np.r_[self.down, _times(self.down[: n - size], pow(step, -1, int(PRIME)))]
        return self.up, self.down


def _times(x: np.ndarray, by: int) -> np.ndarray:
    out = np.empty(len(x), np.uint32)
    for at in range(0, len(x), CHUNK):
        out[at : at + CHUNK] = _mod(x[at : at + CHUNK].astype(np.uint64) * np.uint64(by))
    return out


_POWERS = tuple(Powers(b) for b in BASES)


class PrefixHash:
    """Prefix arrays of a text given as code points."""

    def __init__(self, points: np.ndarray) -> None:
        self.n = len(points)
        self.prefix, self.down = [], []
        for p in _POWERS:
            up, down = p.upto(self.n + 1)
            sums, carry = np.zeros(self.n + 1, np.uint32), np.uint64(0)
            for at in range(0, self.n, CHUNK):
                values = points[at : at + CHUNK].astype(np.uint64) + np.uint64(1)
                part = _mod(np.cumsum(_mod(values * up[at : at + len(values)])) + carry)
                sums[at + 1 : at + 1 + len(part)] = part
                carry = part[-1]
            self.prefix.append(sums)
            self.down.append(down)

    def grams(self, length: int) -> Iterator[np.ndarray]:
        """62-bit hashes of all spans of this length, in order, in pieces."""
        count = self.n - length + 1
        for at in range(0, count, CHUNK):
            to = min(count, at + CHUNK)
            a, b = (_mod((p[at + length : to + length] + PRIME - p[at:to]) * d[at:to]) for p, d in zip(self.prefix, self.down, strict=True))
            yield a << np.uint64(31) | b

    def span(self, start: int, length: int) -> int:
        """62-bit hash of the span [start, start + length), the same wherever its text stands."""
        a, b = ((int(p[start + length]) - int(p[start])) * int(d[start]) % MERSENNE for p, d in zip(self.prefix, self.down, strict=True))
        return a << 31 | b

    def equal(self, start: int, other: PrefixHash, other_start: int, length: int) -> bool:
        """Whether two spans hash alike (equal spans always do; others with probability about (n / 2^31)^2)."""
        return self.span(start, length) == other.span(other_start, length)

    def common_extension(self, start: int, other: PrefixHash, other_start: int) -> int:
        """Length of the longest common extension from the two positions, by binary search."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, other_start, middle):
                low = middle
            else:
                high = middle - 1
        return low


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def sketch(prefix: PrefixHash) -> np.ndarray:
    """The least SLOTS distinct scrambled hashes of the text's spans, rising; a short text is one span, an empty one has none."""
    if not prefix.n:
        return np.zeros(0, np.uint32)
    kept = np.zeros(0, np.uint32)
    for hashes in prefix.grams(min(SPAN, prefix.n)):
        mixed = ((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
        want = SLOTS
        while True:
            least = np.unique(mixed if want >= len(mixed) else np.partition(mixed, want - 1)[:want])
            if len(least) >= SLOTS or want >= len(mixed):
                break
            want *= 2
        kept = np.union1d(kept, least)[:SLOTS]
    return kept


def fingerprint(text: str, prefix: PrefixHash | None = None) -> str:
    """16 hex digits of the whole text's hash (and length), then 8 for each value of the sketch."""
    prefix = prefix or PrefixHash(code_points(text))
    whole = (prefix.span(0, prefix.n) ^ prefix.n * 0x9E3779B97F4A7C15) % (1 << 64)
    return f"{whole:016x}" + sketch(prefix).astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1: 1 for equal texts, else the share of the union's least values that both have."""
    if a[:WHOLE] == b[:WHOLE]:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f[WHOLE:]), ">u4").astype(np.uint32) for f in (a, b))
    union = np.union1d(x, y)[:SLOTS]
    return float(np.isin(union, np.intersect1d(x, y, assume_unique=True)).sum() / len(union)) if len(union) else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "row long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_edited long, same_next long"


def _compare(rows: list[tuple[int | None, str, str]]) -> dict[str, list]:
    """What the query asks of each (row, text, next text)."""
    out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
    carried: tuple[str, PrefixHash, str] | None = None
    for row, text, following in rows:
        if carried is None or carried[0] is not text:
            own = PrefixHash(code_points(text))
            carried = text, own, fingerprint(text, own)
        _, own, mark = carried
        after = PrefixHash(code_points(following))
        next_mark = fingerprint(following, after)
        changed = edited(text, following)
        change = PrefixHash(code_points(changed))
        change_mark = fingerprint(changed, change)
        values = row, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), mark, change_mark, likeness(mark, change_mark), likeness(mark, next_mark), own.common_extension(0, change, 0), own.common_extension(0, after, 0)
        for column, value in zip(out.values(), values, strict=True):
            column.append(value)
        carried = following, after, next_mark
    return out


def compare_with_next(docs: DataFrame, text: str = "text", row: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited text, and likeness to the edited and to the next document.

    The next document is the one with the next smaller id; the last is followed by the first.  Columns: ``SCHEMA``;
    same_edited and same_next are the longest common extensions from the two texts' starts.  Null texts are empty.
    Rows without an id come after all others; rows of one id follow in the order of a hash of their texts.  Alone, a
    document follows itself.  Other columns are not read; an empty table gives an empty result.  A text of any length
    is hashed whole: with the next text, the edited text and the powers it takes about 40 bytes a code point.

    The texts are shuffled once, by ranges of ids that a scan of the ids alone has settled; each range also receives
    the row that follows its last one, so that no range waits for another and no single task orders the table.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(row).cast("long").alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(given.where("row is not null").approxQuantile("row", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    edges = np.array([-int(b) for b in reversed(bounds)], np.int64)  # ranges in falling order of ids

    def ranges(ids: pd.Series) -> np.ndarray:
        known = ids.notna().to_numpy()
        out = np.full(len(ids), len(edges), np.int32)
        out[known] = np.searchsorted(edges, -ids[known].to_numpy().astype(np.int64), "right")
        return out

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(ranges(ids))

    numbered = given.select("row", range_of("row").alias("part"))
    heads = {r["part"]: r["head"] for r in numbered.groupBy("part").agg(F.max("row").alias("head")).collect()}  # a row for each range
    order = sorted(heads)
    before = {p: order[i - 1] for i, p in enumerate(order)}

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        """The row's range and, if it comes first there, the range before."""
        own = ranges(ids).tolist()
        return pd.Series([[p, before[p]] if (pd.isna(i) if heads[p] is None else i == heads[p]) else [p] for p, i in zip(own, ids.tolist(), strict=True)])

    twice = given.select("row", "text", F.posexplode(places("row")).alias("copy", "part"))
    rows = twice.select("part", (F.col("copy") > 0).alias("tail"), "row", "text", F.xxhash64("text").alias("tie"))
    dealt = rows.repartitionById(max(order, default=0) + 1, "part")
    ordered = dealt.sortWithinPartitions("part", "tail", F.col("row").desc_nulls_last(), "tie", "text").select("part", "tail", "row", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple[int, int | None, str] | None = None
        for piece, texts in text_chunks(batches):
            ready = []
            for p, tail, r, t in zip(piece.column("part").to_pylist(), piece.column("tail").to_pylist(), piece.column("row").to_pylist(), texts, strict=True):
                if waiting is not None and waiting[0] == p:
                    ready.append((waiting[1], waiting[2], t))
                waiting = None if tail else (p, r, t)
            if ready:
                yield pa.RecordBatch.from_pydict(_compare(ready), schema=arrow)

    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    arrow = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in SCHEMA.split(", "))])
    return ordered.mapInArrow(run, SCHEMA)
