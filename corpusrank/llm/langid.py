"""Language identification (operator 6) by prediction by partial matching over bytes.

Each language has a context tree: counts of every byte after every context of 0 to ``ORDER`` bytes.  A byte costs
-log2 of its probability in the longest context that the language has seen; if the byte is new there, the escape's
cost is added and the next shorter context decides, down to 8 bits for any byte.  An escape has probability
distinct / (total + distinct).  The counts are frozen after training, so a byte's cost is a function of the last
ORDER + 1 bytes: all languages' costs are laid out beside each other in one row per n-gram, and scoring is one hash
lookup a byte for most bytes.  A text's language is the one with the shortest code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, kept_columns, kept_texts, ragged, unkept
from .hashindex import HashIndex

ORDER = 4
#: The training sample: at most so many documents of a language, none of them longer than so many characters.
TRAIN_DOCS, TRAIN_CHARS = 400, 1 << 15
#: Bits that an unmodelled byte costs, besides its escapes.
RAW = 8.0
#: At most so many languages are learned, those with the most documents.
MOST_LANGS = 64
#: A text of n bytes is in no learned language if its code takes MARGIN bits a byte more than all but the most costly
#: fiftieth of the learned languages' documents, and CHANCE / sqrt(n) more for the chance of single bytes (8 deviations).
MARGIN, CHANCE = 4.0, 24.0
#: The same without documents to tell what is usual: bits a byte.
REJECT = 10.0
#: Bytes whose costs are held at a time.
WINDOW = 1 << 20
DIGITS = bytes.maketrans(b"123456789", b"0" * 9)
UNKNOWN = "und"


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte from position ORDER on: it and the ``order`` bytes before it, as one number."""
    n = len(data) - ORDER
    out = np.zeros(max(n, 0), np.uint64)
    for back in range(order, -1, -1):
        out = out << np.uint64(8) | data[ORDER - back : ORDER - back + n].astype(np.uint64)
    return out


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in a row, each after ORDER line feeds; start and length of each text in it.

    Letter case and the digits' values say nothing of a language: texts are lower-cased, and all digits are 0.
    """
    raw = [t.lower().encode("utf-8", "surrogatepass").translate(DIGITS) for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"\n" * ORDER + (b"\n" * ORDER).join(raw), np.uint8)
    return data, np.cumsum(sizes + ORDER) - sizes, sizes


class ContextTrees:
    """Frozen code lengths of several languages; tables[k] has the n-grams of k + 1 bytes that any of them has seen."""

    def __init__(self, texts: dict[str, list[str]]) -> None:
        self.usual: float | None = None
        self.langs = sorted(texts)
        count = len(self.langs)
        streams = []
        for lang in self.langs:
            data, starts, sizes = _bytes(texts[lang])
            streams.append((data, ragged(starts - ORDER, sizes)))
        self.index: list[HashIndex] = []
        self.cost: list[np.ndarray] = []
        self.context: list[HashIndex] = []
        self.escape: list[np.ndarray] = []
        for k in range(ORDER + 1):
            seen = [np.unique(_grams(d, k)[own], return_counts=True) for d, own in streams]
            keys = np.unique(np.concatenate([g for g, _ in seen])) if seen else np.zeros(0, np.uint64)
            contexts = np.unique(keys >> np.uint64(8))
            escape = np.zeros((len(contexts) + 1, count), np.float32)
            cost = np.full((len(keys), count), np.nan, np.float32)
            for lang, (grams, times) in enumerate(seen):
                if not len(grams):
                    continue
                own, first, distinct = np.unique(grams >> np.uint64(8), return_index=True, return_counts=True)
                total = np.add.reduceat(times, first)
                at = np.searchsorted(own, grams >> np.uint64(8))
                cost[np.searchsorted(keys, grams), lang] = -np.log2(times / (total + distinct)[at])
                escape[np.searchsorted(contexts, own), lang] = -np.log2(distinct / (total + distinct))
            self.context.append(HashIndex(contexts))
            self.escape.append(escape)
            if count and len(keys):
                lower = self._below(k, keys) if k else np.full((len(keys), count), RAW, np.float32)
                fall = escape[np.searchsorted(contexts, keys >> np.uint64(8))] + lower
                cost = np.where(np.isnan(cost), fall, cost)
            self.index.append(HashIndex(keys))
            self.cost.append(cost)

    def _below(self, k: int, grams: np.ndarray) -> np.ndarray:
        """Costs of n-grams of k + 1 bytes in the contexts shorter than k."""
        return self._costs(k - 1, grams & np.uint64((1 << 8 * k) - 1))

    def _costs(self, k: int, grams: np.ndarray) -> np.ndarray:
        row = self.index[k].find(grams)
        out = self.cost[k][row] if len(self.cost[k]) else np.zeros((len(grams), len(self.langs)), np.float32)
        new = np.flatnonzero(row < 0)
        if len(new):
            lower = self._below(k, grams[new]) if k else np.float32(RAW)
            out[new] = self.escape[k][self.context[k].find(grams[new] >> np.uint64(8))] + lower  # -1: the last row, no escape
        return out

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text under each language: float64[texts, languages]."""
        data, starts, sizes = _bytes(texts)
        first, out = starts - ORDER, np.zeros((len(texts), len(self.langs)))
        for at in range(0, len(data) - ORDER, WINDOW):
            costs = self._costs(ORDER, _grams(data[at : at + WINDOW + ORDER], ORDER))
            upto = np.zeros((len(costs) + 1, len(self.langs)))
            np.cumsum(costs, axis=0, out=upto[1:])
            here = slice(int(np.searchsorted(first + sizes, at, "right")), int(np.searchsorted(first, at + len(costs), "left")))
            out[here] += upto[np.minimum(first[here] + sizes[here] - at, len(costs))] - upto[np.maximum(first[here] - at, 0)]
        return out

    def learn_usual(self, texts: dict[str, list[str]]) -> None:
        """Take what bits a byte are usual from documents of the learned languages that were not counted (256 characters at least)."""
        bits = [b for t in texts.values() for _, _, b in predict_texts(self, [x for x in t if len(x) >= 256])]
        if bits:
            self.usual = float(np.quantile(bits, 0.98))


def is_held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2 (a null id: not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS, most_langs: int = MOST_LANGS, text: str = "text", lang: str = "lang", row: str = "doc_id") -> ContextTrees:
    """Fit the context trees on a bounded sample of the rows that are not held out and have a language.

    Each language gives at most ``train_docs`` whole documents of at most ``train_chars`` characters, drawn by a hash
    of id and text, and the driver draws half as many more, by which ``learn_usual`` sets what code length is usual (a
    fourth of the documents, where a language has no more).  The ``most_langs`` languages with the most documents are
    learned, of as many documents the first by name.  Null texts and languages and empty texts are left out; repeated
    rows count each; other columns are not read.  Without a row that serves, the model has no language.
    """
    fit = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(row), F.lit(1)).alias("draw"), is_held_out(row).alias("out"))
    fit = fit.where(~F.col("out") & F.col("lang").isNotNull() & F.col("text").isNotNull()).where(F.length("text").between(1, train_chars))
    counts = fit.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    texts: dict[str, list[str]] = {}
    if counts:
        shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 1.5 * train_docs / r["n"])) for r in counts], "lang string, share double")
        drawn = fit.join(F.broadcast(shares), "lang").where(F.pmod("draw", F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("lang", "draw", "text")
        for name, _, value in sorted(drawn.collect(), key=lambda r: (r[0], r[1], r[2])):
            texts.setdefault(name, []).append(value)
    counted = {name: min(train_docs, -(-3 * len(own) // 4)) for name, own in texts.items()}
    model = ContextTrees({name: own[: counted[name]] for name, own in texts.items()})
    model.learn_usual({name: own[counted[name] :] for name, own in texts.items()})
    return model


def predict_texts(model: ContextTrees, texts: list[str | None]) -> list[tuple[str, float, float]]:
    """(language, posterior, bits a byte of the best code) of each text; null or letterless texts are undetermined."""
    known = [i for i, t in enumerate(texts) if t is not None and model.langs and any(map(str.isalpha, t))]
    out = [(UNKNOWN, 0.0, RAW)] * len(texts)
    if known:
        bits = model.code_lengths([texts[i] for i in known])
        best = bits.argmin(1)
        least = bits[np.arange(len(known)), best]
        share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        for n, i in enumerate(known):
            out[i] = model.langs[best[n]], float(share[n]), float(least[n] / len(texts[i].encode("utf-8", "surrogatepass")))
    return out


def identify(docs: DataFrame, model: ContextTrees, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: doc_id) and lang_pred, score, bits_per_byte of every row.

    score is the posterior of the best language under equal priors, from the whole text's code lengths; bits_per_byte
    is the best code length over the text's bytes.  A null text or one without a
    letter is ``und`` with score 0; so is any text if no language was learned.  Ties go to the language that sorts first.
    Rows are kept as they are, with texts of any length; of a kept column that is called like a new one, the new one
    gets underscores (``own_names``).  An empty table gives an empty result.
    """
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    given, schema = kept_columns(docs, keep, text)
    read = kept_texts(docs, keep, text, chars=1 << 18)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept, texts in read(batches):
            lang, score, bits = zip(*predict_texts(shared.value, texts), strict=True)
            yield pa.RecordBatch.from_arrays([kept, pa.array(lang), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], names=["kept", "lang_pred", "score", "bits_per_byte"])

    found = given.mapInArrow(run, f"kept {schema}, lang_pred string, score double, bits_per_byte double")
    return unkept(found, keep, "lang_pred", "score", "bits_per_byte")


def accepted(model: ContextTrees, lang_pred: str = "lang_pred", bits: str = "bits_per_byte", text: str = "text") -> Column:
    """What a corpus filter keeps: a language was found, and the code is not longer than texts of a learned language take."""
    limit = F.lit(REJECT)
    if model.usual is not None:
        limit = model.usual + MARGIN + CHANCE / F.sqrt(F.octet_length(column(text)))
    return (column(lang_pred) != UNKNOWN) & (column(bits) < limit)
