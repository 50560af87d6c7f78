"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint, pinned, release

__all__ = ["checkpoint", "column", "columns", "give_back", "kept_columns", "kept_texts", "own_names", "parallel", "pinned", "ragged", "release", "table", "text_chunks", "unkept", "worker_cache"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [column(c) for c in df.columns]


def own_names(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until no taken column and no name before it is called so (letter case aside)."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def parallel(spark: SparkSession) -> int:
    """Partitions for a shuffle of small rows."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = 1 << 20, owner: str = "") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about ``chars`` bytes of text each (or one row, if it is longer), and their texts; null becomes empty.

    Only one slice's texts are Python objects at a time, and what a task has freed goes back to the system at its end:
    workers live on, and several share an executor's memory.
    """
    if owner not in _caches:
        _caches.clear()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and size + n > chars:
                yield _chunk(batch.slice(start, i - start), column)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield _chunk(batch.slice(start), column)
    give_back()


_caches: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What this Python worker keeps between an operator's tasks; the first task of another operator drops it."""
    if owner not in _caches:
        _caches.clear()
        _caches[owner] = {}
    return _caches[owner]


def give_back() -> None:
    """Return freed memory of this Python worker to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _chunk(part: pa.RecordBatch, column: str) -> tuple[pa.RecordBatch, list[str]]:
    return part, ["" if t is None else t for t in part.column(column).to_pylist()]


def kept_columns(df: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, str]:
    """(struct ``kept`` of the columns to keep, text) for a Python stage, with the struct's type; the text is not sent twice."""
    kept = F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(keep)])
    out = df.select(kept.alias("kept"), F.lit(None).cast("string").alias("text") if _is_text(df, keep, text) else F.col(text).cast("string").alias("text"))
    return out, out.schema["kept"].dataType.simpleString()


def _is_text(df: DataFrame, keep: list[str], text: str) -> bool:
    return text in keep and df.schema[text].dataType.simpleString() == "string"


def kept_texts(df: DataFrame, keep: list[str], text: str, chars: int = 1 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.Array, list[str | None]]]]:
    """Reads what ``kept_columns`` made: slices of the kept structs and their texts (null as None)."""
    at = keep.index(text) if _is_text(df, keep, text) else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
        for batch in batches:
            kept = batch.column("kept")
            texts = kept.field(at) if at is not None else batch.column("text")
            own = pa.RecordBatch.from_arrays([kept, texts], names=["kept", "text"])
            for part, _ in text_chunks(iter([own]), chars=chars):
                yield part.column("kept"), part.column("text").to_pylist()

    return read


def unkept(df: DataFrame, keep: list[str], *others: str) -> DataFrame:
    """The kept columns under their names again, and the others under names that none of those has (``own_names``)."""
    named = zip(others, own_names(keep, *others), strict=True)
    return df.select(*[F.col("kept")[f"c{i}"].alias(c) for i, c in enumerate(keep)], *[F.col(o).alias(n) for o, n in named])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices that read the spans ``starts[i] : starts[i] + lengths[i]`` one after another."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)
