"""Semi- and anti-joins of wide rows that shuffle only the rows in question.

A Bloom filter of fixed size over the ids is built by one aggregation and broadcast (``BITS`` / 8 bytes, whatever the
data).  Rows that it rules out are settled where they are; the others go through an exact join, so the filter changes
what is moved and never the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns

BITS = 1 << 24


def _places(ids: np.ndarray) -> list[np.ndarray]:
    x = ids.astype(np.int64).view(np.uint64)
    return [((x ^ x >> np.uint64(31)) * np.uint64(m) >> np.uint64(64 - 24)).astype(np.int64) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def bloom_filter(ids: DataFrame) -> np.ndarray:
    """The filter's bits (uint32 words) over the one-column ``ids`` (bigint; nulls are left out)."""

    @F.pandas_udf("array<int>")
    def places(values: pd.Series) -> pd.Series:
        return pd.Series(np.stack(_places(values.to_numpy()), axis=1).tolist(), index=values.index)

    name = ids.columns[0]
    at = ids.where(F.col(name).isNotNull()).select(F.explode(places(F.col(name))).alias("at"))
    words = at.groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, at % 32)")).alias("bits"))
    held = words.toArrow()  # BITS / 32 rows at most
    table = np.zeros(BITS // 32, np.uint32)
    table[held.column("word").to_numpy()] = held.column("bits").to_numpy().astype(np.uint32)
    return table


def holds(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each id: never false for one that went in."""
    out = np.ones(len(ids), bool)
    for place in _places(ids):
        out &= (table[place >> 5] >> (place & 31).astype(np.uint32) & 1).astype(bool)
    return out


def might_hold(ids: DataFrame, column: str) -> Column:
    """A condition on ``column`` (bigint) that holds for every id of the one-column ``ids``, and for few others."""
    shared = ids.sparkSession.sparkContext.broadcast(bloom_filter(ids))

    @F.pandas_udf("boolean")
    def might(values: pd.Series) -> pd.Series:
        known, out = values.notna().to_numpy(), np.zeros(len(values), bool)
        out[known] = holds(shared.value, values[known].to_numpy())
        return pd.Series(out, index=values.index)

    return might(F.col(column))


def keep_only(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` is among the ids (a null is not)."""
    name = ids.columns[0]
    return rows.where(might_hold(ids, column)).join(ids.select(F.col(name).alias(column)), column, "left_semi").select(*columns(rows))


def keep_others(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` is not among the ids (a null is not)."""
    name = ids.columns[0]
    might = might_hold(ids, column)
    doubtful = rows.where(might).join(ids.select(F.col(name).alias(column)), column, "left_anti").select(*columns(rows))
    return rows.where(~might).unionByName(doubtful)
