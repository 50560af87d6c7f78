"""SimHash near-duplicates (operator 1): word-shingle fingerprints, bit-sliced Hamming comparison, connected classes.

Two ways to find what to compare are offered.

* ``classes_within`` is exact for a small radius r.  The 64 bits are cut into r + 2 blocks; two fingerprints within r
  share two whole blocks, so each fingerprint enters C(r + 2, 2) buckets.  A bucket over ``HOT`` fingerprints is cut
  again by its remaining bits (r + 1 blocks, one of them shared), and once more; what is left of 64 bits then bounds a
  bucket.  No bucket is capped and no link is lost.
* ``near_duplicates`` serves shingle similarity (five words, 0.8 or more), where fingerprints may differ in many bits.
  Buckets are four min-wise shingle hashes (a pair of similarity 0.8 misses all four with probability 0.0016), the
  bit-sliced comparison with a wide radius leaves candidates, a 256-slot sketch estimates their similarity, and pairs
  whose estimate is near the threshold are settled by their shingles until their ends are in one class.  A large bucket
  is dealt into tiles, whose links make most of it one class; what then is still of several classes is bucketed by
  further hashes, and at the end every two rows of different classes that still share a large bucket are compared.

Inside a bucket only a spanning forest of the links leaves the task, so copies are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitslice
from .bloom import bloom_filter, holds
from .common import checkpoint, give_back, release, text_chunks
from .components import connected_components

SEED = 42
SLOTS = 256
#: Bucket keys of a text, and as many again for each time that large buckets are bucketed anew.
KEYS, LEVELS = 4, 3
#: Odd multipliers that permute 64-bit shingle hashes, one for each key: drawn, as small multiples of each other would have
#: the same shingle as their least in most texts.
PERMUTE = tuple(xxhash.xxh64_intdigest(f"key {k}", SEED) | 1 for k in range(LEVELS * KEYS))
#: A bucket with more distinct rows than this is dealt out before it is compared.
HOT = 4096
#: Similarity 0.8 is 27 degrees between shingle sets, 9.7 of 64 bits on average; 20 is over three and a half deviations more.
WIDE = 20
#: Three deviations of a sketch's estimate: pairs this near to the threshold are checked exactly.
DOUBT = 0.07
#: Shingles of a bucket that one task checks exactly (32 MB).
SHINGLES = 1 << 22


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of the text's words, repeats included.

    A-Z is lower-cased; words are runs without space, tab, line feed, vertical tab, form feed or carriage return
    (what bytes.split() cuts at).  Fewer words than a shingle: the whole sequence is one; none: no hash.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    n = max(1, len(w) - words + 1)
    parts = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, SEED) for p in parts), np.uint64, n)


def simhash(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; no hash: 0."""
    n = len(hashes)
    if not n:
        return 0
    raw = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 255):  # a byte holds what 255 rows add
        votes += np.add.reduce(np.unpackbits(raw[at : at + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def sketch(hashes: np.ndarray) -> bytes:
    """One-permutation minima: the top byte of a hash names the slot, a byte of the slot's least hash fills it (0: empty)."""
    out = np.zeros(SLOTS, np.uint8)
    if len(hashes):
        ordered = np.sort(hashes * np.uint64(0xD6E8FEB86659FD93))
        slot = (ordered >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        out[slot[first]] = (ordered[first] % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return out.tobytes()


def simhash_fingerprints(docs: DataFrame, words: int = 3, text: str = "text", row: str = "doc_id") -> DataFrame:
    """(row, fp): each document's fingerprint as a bigint bit pattern; a null or blank text has fingerprint zero.

    Rows are kept as they are (repeats, null ids); other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            fps = np.array([simhash(shingle_hashes(t, words)) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(fps.view(np.int64))], names=["row", "fp"])

    return docs.select(F.col(row).cast("long").alias("row"), F.col(text).cast("string").alias("text")).mapInArrow(run, "row long, fp long")


def hex16(fp: str | Column) -> Column:
    """A bigint bit pattern as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _blocks(bits: list[int], parts: int) -> list[int]:
    """Masks that cut the given bit positions into ``parts`` runs of nearly equal length."""
    edges = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(edges, edges[1:], strict=False)]


def first_masks(radius: int) -> list[int]:
    """Bit masks such that fingerprints within the radius agree under at least one of them."""
    return [a | b for a, b in combinations(_blocks(list(range(64)), radius + 2), 2)]


def finer_masks(mask: int, radius: int) -> list[int]:
    """The same for fingerprints that agree under ``mask`` already: each result extends it."""
    return [mask | m for m in _blocks([b for b in range(64) if not mask >> b & 1], radius + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """A row for each fingerprint and mask: mask number, what the mask leaves."""
    keys = F.array(*[F.struct(F.lit(k).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])
    return fps.select("fp", F.explode(keys).alias("k")).select("k.m", "k.key", "fp")


def bucket_links(rows: DataFrame, link: Callable[[dict[str, np.ndarray], np.ndarray], tuple[np.ndarray, ...]], gives: tuple[str, ...] = ("a", "b"), by: str = "key") -> DataFrame:
    """Run ``link`` over whole buckets: rows are dealt by ``by`` (bigint) and sorted; ``link`` gets columns and bucket ends of many buckets at once.

    Buckets are cut at ``HOT`` rows before this, so that a task holds a bounded number of rows of one bucket.
    """
    names = rows.columns

    def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {}
        for name in names:
            c = batch.column(name)
            out[name] = np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, SLOTS) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False)
        return out

    def solve(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        cols = {n: np.concatenate([h[n] for h in held]) for n in names}
        key = cols[by]
        edges = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
        ends = np.repeat(edges[1:], np.diff(edges))
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in link(cols, ends)], names=list(gives))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = columns(batch)
            last = np.flatnonzero(cols[by] != cols[by][-1])
            cut = int(last[-1]) + 1 if len(last) else 0
            if held and cut == 0 and held[-1][by][-1] != cols[by][0]:
                yield solve(held)
                held = []
            if cut:
                yield solve([*held, {n: v[:cut] for n, v in cols.items()}])
                held = []
            held.append({n: v[cut:] for n, v in cols.items()})
        if held:
            yield solve(held)
        held.clear()
        give_back()

    return rows.repartition(by).sortWithinPartitions(by).mapInArrow(run, ", ".join(f"{g} long" for g in gives))


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    labels = np.arange(n)
    for i, j in pairs:
        bitslice.hook(labels, i, j)
    child = np.flatnonzero(labels != np.arange(n))
    return child, labels[child]


def classes_within(fps: DataFrame, radius: int = 2, hot: int = HOT) -> DataFrame:
    """(fp) distinct fingerprints -> (fp, root): the least fingerprint reachable by links of at most ``radius`` bits, for those that have one.

    Exact at every size: see the module's text.  Buckets are counted by a partial aggregation first; hot ones are
    refined twice at most, after which the bits that can still differ bound a bucket.
    """

    def link(cols: dict[str, np.ndarray], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fp = cols["fp"].view(np.uint64)
        child, root = _forest(len(fp), bitslice.near_pairs(fp, ends, radius))
        return cols["fp"][child], cols["fp"][root]

    masks = first_masks(radius)
    rows, found = _keyed(fps, masks), None
    for level in range(3):
        crowded = checkpoint(rows.groupBy("m", "key").count().where(F.col("count") > hot).select("m", "key")) if level < 2 else None
        none = crowded is None or crowded.isEmpty()
        usual = rows if none else rows.join(crowded, ["m", "key"], "left_anti")
        links = bucket_links(usual.select(F.xxhash64("m", "key").alias("key"), "fp"), link)
        found = links if found is None else found.unionByName(links)
        if none:
            break
        finer = [finer_masks(m, radius) for m in masks]
        inside, parts = rows.join(crowded, ["m", "key"], "left_semi"), []
        for m, more in enumerate(finer):
            keys = F.array(*[F.struct(F.lit(m * len(more) + k).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(x))).alias("key")) for k, x in enumerate(more)])
            parts.append(F.when(F.col("m") == m, keys))
        rows = inside.select("fp", F.explode(F.coalesce(*parts)).alias("k")).select("k.m", "k.key", "fp")
        masks = [x for more in finer for x in more]
    return connected_components(found).withColumnsRenamed({"node": "fp", "component": "root"})


def near_classes(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text): fingerprints link at ``radius`` or fewer bits.

    component_id is the smallest doc_id reachable, the document itself included; rows without a doc_id link like any
    other but are nobody's smallest (null if a class has no id at all).  Null and blank texts have fingerprint zero and
    link with each other.  Repeated rows each get their row.  An empty table gives an empty result.
    """
    rows = checkpoint(simhash_fingerprints(docs, words))
    groups = rows.groupBy("fp").agg(F.min("row").alias("least"))
    roots = checkpoint(classes_within(groups.select("fp"), radius))
    joined = groups.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = joined.join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select(F.col("row").alias("doc_id"), "fp", "component_id")


# ---- similarity of shingle sets -----------------------------------------------------------------------------------


def signatures(docs: DataFrame, words: int, text: str, row: str) -> DataFrame:
    """(row, same, fp, keys, sketch): a hash of the word sequence, and fingerprint, bucket keys and sketch of each text's distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            fps, keys, same, sketches = [], [], [], []
            for t in texts:
                h = np.unique(shingle_hashes(t, words))  # similarity is one of sets: repeats must not weigh
                fps.append(simhash(h))
                keys.append([int((h * np.uint64(p)).min()) for p in PERMUTE] if len(h) else [0] * len(PERMUTE))
                same.append(xxhash.xxh64_intdigest(b" ".join(t.encode("utf-8", "surrogatepass").lower().split()), 7))
                sketches.append(sketch(h))
            u = lambda v: pa.array(np.array(v, np.uint64).ravel().view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(PERMUTE)), u(keys))
            yield pa.RecordBatch.from_arrays([part.column("row"), u(same), u(fps), lists, pa.array(sketches, pa.binary())], names=["row", "same", "fp", "keys", "sketch"])

    return docs.select(F.col(row).cast("long").alias("row"), F.col(text).cast("string").alias("text")).mapInArrow(run, "row long, same long, fp long, keys array<long>, sketch binary")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of sketches, row by row: equal slots over slots that either fills."""
    used = ((a != 0) | (b != 0)).sum(1)
    return ((a == b) & (a != 0)).sum(1) / np.maximum(used, 1)


def _likely_links(labels: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], sketches: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, rows): a spanning forest of the pairs whose estimate is at least similarity + ``DOUBT``; ``labels`` become its classes.

    ``labels`` (changed in place) say what is in one class from the start.  ``rows`` are all those with a pair down to
    similarity - ``DOUBT`` between two classes.  Whether such pairs link is not decided here, and none of them is left
    out for another.
    """
    sure, open_pairs, rows = [], np.zeros((2, 0), np.int64), np.zeros(len(labels), bool)
    for i, j in pairs:
        for at in range(0, len(i), 1 << 14):
            x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            apart = labels[x] != labels[y]
            x, y = x[apart], y[apart]
            score = likeness(sketches[x], sketches[y])
            certain = score >= similarity + DOUBT
            used = bitslice.span(labels, x[certain], y[certain])
            sure.append(np.stack([x[certain][used], y[certain][used]]))
            maybe = ~certain & (score >= similarity - DOUBT)
            open_pairs = np.concatenate([open_pairs, np.stack([x[maybe], y[maybe]])], axis=1)
            if open_pairs.shape[1] > 1 << 18:
                rows[open_pairs[:, labels[open_pairs[0]] != labels[open_pairs[1]]]] = True
                open_pairs = open_pairs[:, :0]
    rows[open_pairs[:, labels[open_pairs[0]] != labels[open_pairs[1]]]] = True
    made = np.concatenate([np.zeros((2, 0), np.int64), *sure], axis=1)
    return made[0], made[1], np.flatnonzero(rows)


def _first_of(ends: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """For each row the first index with its bucket and root."""
    order = np.lexsort((roots, ends))  # stable: a group's first row comes first
    new = np.r_[True, (ends[order][1:] != ends[order][:-1]) | (roots[order][1:] != roots[order][:-1])][: len(order)]
    out = np.empty(len(order), np.int64)
    out[order] = order[new][np.cumsum(new) - 1]
    return out


def _similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least the similarity."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return False
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return common >= similarity * (len(x) + len(y) - common)


def _exact_forest(labels: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], sketches: np.ndarray, sets: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): pairs whose sets have the similarity and that join the classes ``labels`` (changed in place).

    Every pair with an estimate of similarity - ``DOUBT`` is checked unless its ends are joined by then: a forest of
    the best estimates is checked, then one over the unchecked pairs that are still between two classes, until none is.
    """
    size, made = np.array([len(x) for x in sets], np.int64), [np.zeros((2, 0), np.int64)]
    for i, j in pairs:
        for at in range(0, len(i), 1 << 14):
            x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            apart = (labels[x] != labels[y]) & (np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]))
            x, y = x[apart], y[apart]
            score = likeness(sketches[x], sketches[y])
            best = np.argsort(-score, kind="stable")[: int((score >= similarity - DOUBT).sum())]
            x, y = x[best], y[best]
            while len(x):
                forest = bitslice.span(labels.copy(), x, y)
                linked = forest[[_similar(sets[u], sets[v], similarity) for u, v in zip(x[forest].tolist(), y[forest].tolist(), strict=True)]]
                made.append(np.stack([x[linked], y[linked]]))
                bitslice.hook(labels, x[linked], y[linked])
                left = labels[x] != labels[y]
                left[forest] = False
                x, y = x[left], y[left]
    both = np.concatenate(made, axis=1)
    return both[0], both[1]


def _exact(docs: DataFrame, doubtful: DataFrame, words: int, similarity: float, text: str, row: str, made: list[DataFrame], most: int = SHINGLES) -> DataFrame:
    """(a, b) row pairs that link what is ``doubtful`` (key, node, root) by distinct shingles.

    In each bucket ``key`` all pairs of rows with an estimate near the threshold or above are checked until they are
    in one class; rows of one root are from the start.  A bucket of more than ``most`` shingles is dealt into tiles, and
    each pair of tiles is a task of its own.  What is written goes to ``made``, to be released.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bloom_filter(doubtful.select("node").distinct()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = (b.filter(pa.array(holds(shared.value, b.column("row").to_numpy(zero_copy_only=False)))) for b in batches)
        for part, texts in text_chunks(asked):
            every = [np.unique(shingle_hashes(t, words)) for t in texts]
            found = [np.sort(h.view(np.int64)) for h in every]
            fps, sketches = pa.array(np.array([simhash(h) for h in every], np.uint64).view(np.int64)), pa.array([sketch(h) for h in every], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("row"), fps, sketches, pa.array(found, pa.list_(pa.int64()))], names=["node", "fp", "sketch", "hashes"])

    def link(cols: dict[str, np.ndarray], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = _exact_forest(_first_of(ends, cols["root"]), bitslice.near_pairs(cols["fp"].view(np.uint64), ends, WIDE), cols["sketch"], cols["hashes"], similarity)
        return np.maximum(cols["node"][i], cols["node"][j]), np.minimum(cols["node"][i], cols["node"][j])

    texts = docs.select(F.col(row).cast("long").alias("row"), F.col(text).cast("string").alias("text"))
    made.append(hashed := checkpoint(texts.mapInArrow(sets, "node long, fp long, sketch binary, hashes array<long>")))  # those that are doubtful, and few others
    sized = doubtful.join(hashed.select("node", F.size("hashes").alias("weight")), "node")
    rows = _tile_pairs(sized, most, "weight").join(hashed, "node")
    made.append(linked := checkpoint(bucket_links(rows.select("key", "node", "root", "fp", "sketch", "hashes"), link)))
    return linked


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, text: str = "text", row: str = "row", hot: int = HOT) -> DataFrame:
    """(row, component): classes of rows whose word shingles are similar; ``component`` is the smallest row of the class.

    ``row`` must name every row differently and not be null; it is read as a bigint.  Rows of equal words (letter case
    and spacing aside) are always in one class, so all null and blank texts are.  Others meet in buckets of a min-wise
    hash, are compared bit-sliced within ``WIDE`` bits, and link if their sketches estimate a similarity well above the
    threshold, or about it and the shingles themselves, read again for such pairs, reach it.  Texts are compared whole,
    of any length; other columns are not read; an empty table gives an empty result.

    No row leaves a bucket unless all that the bucket holds is one class already.  A bucket over ``hot`` texts is dealt
    into tiles twice, in two ways, so that a group of similar texts becomes one class although no task sees all of it.
    Where several classes are left, the bucket's rows are bucketed again by a further min-wise hash besides the first,
    and once more; what is still crowded and of several classes after three shared hashes meets in full.
    """
    made = [rows := checkpoint(signatures(docs, words, text, row))]
    made.append(texts := checkpoint(rows.groupBy("same").agg(F.min("row").alias("node"), F.first(F.struct("fp", "keys", "sketch")).alias("s")).select("same", "node", "s.*")))

    def compared(work: DataFrame, classes: DataFrame | None) -> DataFrame:
        """(a, b) links that a task finds in its buckets (node, key), between rows of different ``classes``."""

        def link(cols: dict[str, np.ndarray], ends: np.ndarray) -> tuple[np.ndarray, ...]:
            labels = _first_of(ends, cols["root"])
            i, j, open_rows = _likely_links(labels, bitslice.near_pairs(cols["fp"].view(np.uint64), ends, WIDE), cols["sketch"], similarity)
            node, sure = cols["node"], np.arange(len(i) + len(open_rows)) < len(i)
            a, b = np.r_[np.maximum(node[i], node[j]), node[open_rows]], np.r_[np.minimum(node[i], node[j]), node[labels[open_rows]]]
            return a, b, sure, cols["key"][np.r_[i, open_rows]]  # not sure: a row and its root in the bucket

        known = _rooted(work.join(texts.select("node", "fp", "sketch"), "node"), classes)
        made.append(found := checkpoint(bucket_links(known.select("key", "node", "root", "fp", "sketch"), link, ("a", "b", "sure", "key"))))
        links = found.where("sure = 1").select("a", "b")
        doubtful = found.where("sure = 0").select("key", F.col("a").alias("node"), F.col("b").alias("root"))
        return links if doubtful.isEmpty() else links.unionByName(_exact(docs, doubtful, words, similarity, text, row, made))

    classes: DataFrame | None = None
    buckets = texts.select("node", F.explode(_numbered(0)).alias("k")).select("node", F.xxhash64("k.j", "k.key").alias("key"))
    for level in range(LEVELS):
        made.append(buckets := checkpoint(buckets))
        made.append(sizes := checkpoint(buckets.groupBy("key").count().where("count > 1")))
        crowded = sizes.where(F.col("count") > hot).withColumn("tiles", F.ceil(F.col("count") / F.lit(hot // 2)))
        full = not crowded.isEmpty()
        work = buckets.join(sizes.where(F.col("count") <= hot), "key").select("node", "key")
        if full:
            work = work.unionByName(_dealt_twice(buckets.join(crowded.select("key", "tiles"), "key")))
        links = compared(work, classes)
        made.append(classes := checkpoint(_joined(links, classes)))
        if not full:
            break
        made.append(left := checkpoint(_unsettled(_rooted(buckets.join(crowded.select("key"), "key"), classes))))
        if left.isEmpty():
            break
        if level == LEVELS - 1:
            made.append(classes := checkpoint(_joined(compared(_crossed(left, hot), classes), classes)))
            break
        finer = left.join(texts.select("node", "keys"), "node").select("node", "key", F.explode(_numbered(level + 1)).alias("k"))
        buckets = finer.select("node", F.xxhash64("key", "k.j", "k.key").alias("key"))
    named = texts.select("same", "node").join(classes, "node", "left").select("same", F.coalesce("component", "node").alias("component"))
    out = checkpoint(rows.select("row", "same").join(named, "same").select("row", "component"))
    for done in made:
        release(done)
    return out


def _numbered(level: int) -> Column:
    """The keys by which a level buckets."""
    return F.array(*[F.struct(F.lit(j).alias("j"), F.col("keys")[j].alias("key")) for j in range(level * KEYS, (level + 1) * KEYS)])


def _rooted(rows: DataFrame, classes: DataFrame | None) -> DataFrame:
    """``rows`` (node, ...) with root, the class of their node as far as it is known."""
    if classes is None:
        return rows.withColumn("root", F.col("node"))
    return rows.join(classes, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")


def _joined(links: DataFrame, classes: DataFrame | None) -> DataFrame:
    """(node, component) of the classes so far and further links."""
    known = links if classes is None else links.unionByName(classes.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return connected_components(known)


def _unsettled(rows: DataFrame) -> DataFrame:
    """Those of ``rows`` (key, node, root) whose bucket holds more than one class."""
    mixed = rows.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    return rows.join(mixed, "key").select("key", "node", "root")


def _dealt_twice(rows: DataFrame) -> DataFrame:
    """(node, key) of ``rows`` (node, key, tiles): each row in two tiles of its bucket, which other rows share."""
    ways = F.explode(F.array(F.lit(0), F.lit(1))).alias("way")
    return rows.select("node", "key", "tiles", ways).select("node", F.xxhash64("key", "way", F.pmod(F.xxhash64("node", "way"), F.col("tiles"))).alias("key"))


def _crossed(rows: DataFrame, hot: int) -> DataFrame:
    """(node, key): buckets of about ``hot`` rows in which any two rows of one bucket of ``rows`` (key, node, root) with different roots meet.

    One of the two is not of the bucket's largest class, so tiles of all rows meet tiles of those alone: where nearly
    all is one class, each row goes to few buckets.
    """
    by_root = rows.groupBy("key", "root").count()
    shares = by_root.groupBy("key").agg(F.max(F.struct("count", "root")).alias("most"), F.sum("count").alias("total"))
    half = F.lit(max(1, hot // 2))
    tiles = shares.select("key", F.col("most.root").alias("main"), F.ceil(F.col("total") / half).alias("n"), F.ceil((F.col("total") - F.col("most.count")) / half).alias("m"))
    given = rows.join(tiles, "key")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    every = given.select("key", "node", F.pmod(F.xxhash64("node"), F.col("n")).alias("x"), upto("m").alias("y"))
    others = given.where("root <> main").select("key", "node", upto("n").alias("x"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("m")).alias("y"))
    return every.unionByName(others).select("node", F.xxhash64("key", "x", "y").alias("key")).distinct()


def _tile_pairs(rows: DataFrame, most: int, weight: str) -> DataFrame:
    """``rows`` (key, node, ...) of buckets that weigh over ``most`` dealt into tiles of about half of that, every pair of tiles as a bucket of its own."""
    total = F.sum(F.expr(weight))
    counts = rows.groupBy("key").agg(F.when(total > most, F.ceil(total / F.lit(most // 2))).otherwise(F.lit(1).cast("long")).alias("tiles"))
    tiled = rows.join(counts, "key").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("tiles") - 1, F.lit(0))), lambda t: F.struct(F.least(t, F.col("tile")).alias("x"), F.greatest(t, F.col("tile")).alias("y")))
    return tiled.withColumn("meet", F.explode(meets)).select(*[c for c in rows.columns if c != "key"], F.xxhash64("key", "meet.x", "meet.y").alias("key"))
