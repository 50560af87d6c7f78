"""How a result page shows numbers, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shown_time(milliseconds: str | Column, even: bool = False) -> Column:
    """Whole milliseconds, halves up as in a browser or, with ``even``, to even as in C and SQL; "< 1" below one."""
    ms = milliseconds if isinstance(milliseconds, Column) else F.col(milliseconds)
    return F.when(ms < 1, F.lit("< 1")).otherwise(F.format_string("%.0f", F.rint(ms) if even else ms))


def shown_score(score: str | Column) -> Column:
    """Two decimals, halves (of the shortest decimal that names the number) up."""
    return F.format_string("%.2f", score if isinstance(score, Column) else F.col(score))
