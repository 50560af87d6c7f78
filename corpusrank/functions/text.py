"""Tokens and n-grams as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "[A-Za-z0-9]+"


def words(text: str | Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, in order; null and empty texts have none.

    Runs are taken before lower-casing, which could make ASCII letters of others.
    """
    return F.transform(F.regexp_extract_all(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), F.lit(WORD), F.lit(0)), F.lower)


def grams(tokens: str | Column, n: int) -> Column:
    """Runs of n adjacent tokens joined by "_" (which no token holds); fewer tokens give none."""
    tokens = tokens if isinstance(tokens, Column) else F.col(tokens)
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws("_", F.slice(tokens, i, n)))


#: Bytes of input, as files hold it, whose grams a task counts before they are shuffled.
DEALT = 1 << 23


def dealt(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` in pieces of about ``DEALT`` bytes, for what a task holds nearly all of its piece's, as rare grams."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 50 else 0  # of what is no file the planner knows no size
    return docs.repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // DEALT)), key)


def gram_counts(docs: DataFrame, n: int, tokens: str = "tokens") -> DataFrame:
    """(gram, cf) of all token lists: grams are joined by place, one row at a time."""
    placed = docs.where(F.size(tokens) >= n).select(tokens, F.explode(F.sequence(F.lit(0), F.size(tokens) - n)).alias("__i"))
    return placed.select(F.concat_ws("_", *[F.get(tokens, F.col("__i") + k) for k in range(n)]).alias("gram")).groupBy("gram").agg(F.count("*").alias("cf"))


def token_positions(docs: DataFrame, tokens: str = "tokens", key: str = "doc_id") -> DataFrame:
    """(key, pos, term), positions from 0."""
    return docs.select(key, F.posexplode(tokens).alias("pos", "term"))


def runs(docs: DataFrame, terms: str, key: str, *others: str) -> DataFrame:
    """(key, term, count, others) of each run of equal terms in a sorted list; others may name the run's first place a (from 1).

    Lists are columns of their own before they are read by place: an expression would be computed anew for every word.
    """
    begins = docs.selectExpr("*", f"filter(transform({terms}, (t, i) -> CASE WHEN i = 0 OR t <> get({terms}, i - 1) THEN i + 1 END), i -> i IS NOT NULL) AS __b")
    count = f"(coalesce(get(__b, k + 1), size({terms}) + 1) - a)"
    fields = ", ".join((f"get({terms}, a - 1) AS term", f"CAST({count} AS bigint) AS count", *(o.format(count=count) for o in others)))
    return begins.selectExpr(key, f"inline(transform(__b, (a, k) -> struct({fields})))")


def log_tf(tf: str | Column) -> Column:
    """1 + ln(tf), 0 where tf is 0."""
    tf = tf if isinstance(tf, Column) else F.col(tf)
    return F.when(tf > 0, 1 + F.log(tf)).otherwise(0.0)


def idf(n: int | Column, df: str | Column) -> Column:
    """ln(n / df), 0 where df is 0; negative where df counts occurrences beyond n."""
    df = df if isinstance(df, Column) else F.col(df)
    return F.when(df > 0, F.log((n if isinstance(n, Column) else F.lit(n)) / df)).otherwise(0.0)
