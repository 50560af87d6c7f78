"""Porter stemming with the usual extensions."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: irregular words and suffix tables of the algorithm
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning",
    "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """'v' or 'c' for each letter; y is a consonant at the start and after a vowel."""
    out: list[str] = []
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or letter == "y" and i > 0 and out[i - 1] == "c"
        out.append("v" if vowel else "c")
    return "".join(out)


def measure(stem: str) -> int:
    """How many vowel runs are followed by a consonant run."""
    return _shape(stem).replace("vv", "v").count("vc") if stem else 0


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y at the end; or a word of just vowel and consonant."""
    shape = _shape(word)
    return shape[-3:] == "cvc" and word[-1] not in "wxy" or shape == "vc"


def _cut(word: str, suffix: str) -> str:
    return word[: len(word) - len(suffix)]


def _first(word: str, rules: tuple, fits: Callable[[str], bool]) -> str:
    """The first rule whose suffix ends the word decides; if its condition fails, nothing changes."""
    for suffix, put in rules:
        if word.endswith(suffix):
            stem = _cut(word, suffix)
            return stem + put if fits(stem) else word
    return word


def _plural(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-1]
    for suffix, put in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suffix):
            return _cut(w, suffix) + put
    return w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return _cut(w, "ied") + ("ie" if len(w) == 4 else "i")
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix):
            stem = _cut(w, suffix)
            if not _has_vowel(stem):
                return w
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c":
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if measure(stem) == 1 and _short_end(stem) else stem
    return w


def _final_y(w: str) -> str:
    stem = w[:-1]
    return stem + "i" if w.endswith("y") and len(stem) > 1 and _shape(stem)[-1] == "c" else w


def _double_suffix(w: str) -> str:
    some = lambda stem: measure(stem) > 0
    if w.endswith("alli") and some(_cut(w, "alli")):
        return _double_suffix(_cut(w, "alli") + "al")
    out = _first(w, STEP2, some)
    if out == w and w.endswith("logi") and not any(w.endswith(s) for s, _ in STEP2):
        return w[:-1] if some(w[:-3]) else w
    return out


def _long_suffix(w: str) -> str:
    for suffix in STEP4:
        if w.endswith(suffix):
            stem = _cut(w, suffix)
            return stem if measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")) else w
    return w


def _final_e(w: str) -> str:
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or m == 1 and not _short_end(w[:-1]):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


@lru_cache(maxsize=1 << 17)
def porter(word: str) -> str:
    """The stem of a word."""
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    w = _double_suffix(_final_y(_past(_plural(w))))
    return _final_e(_long_suffix(_first(w, STEP3, lambda stem: measure(stem) > 0)))


@F.pandas_udf(T.StringType())
def porter_stem(words: pd.Series) -> pd.Series:
    """Stems of a column of words."""
    return words.map(porter, na_action="ignore")


@F.arrow_udf(T.ArrayType(T.StringType()))
def porter_stem_all(lists: pa.Array) -> pa.Array:
    """Stems of a column of word lists.

    Each distinct word of a batch is stemmed once, and only those become Python strings: what a worker holds besides
    the batch grows with the vocabulary of a batch, not with its words.
    """
    coded = lists.flatten().dictionary_encode()
    stems = pa.array([porter(w) for w in coded.dictionary.to_pylist()], pa.string())
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int32()))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    return pa.ListArray.from_arrays(offsets, stems.take(coded.indices), mask=lists.is_null())


def stem_terms(rows: DataFrame, term: str = "term") -> DataFrame:
    """``rows`` with ``term`` replaced by its stem, row by row where they lie."""
    return rows.withColumn(term, porter_stem(term))


def analyzed(words: Column, analyzer: str) -> Column:
    """A list of lower-cased words as the analyzer's terms."""
    return porter_stem_all(words) if analyzer == "stem" else words
