"""Connected components over an edge DataFrame, without any driver-side state that grows with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, release


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) bigint edges -> (node, component): the smallest node reachable, for every node that has an edge.

    Alternates large-star and small-star rounds: each round hangs neighbours on the smallest node around them, so the
    depth shrinks geometrically.  Every round is two partial aggregations and two equi-joins; a hub's rows are split
    by the adaptive skew join.  Each round is written to the
    shared checkpoint folder, and the one before deleted.  Self-loops, repeated edges and null ends are ignored.
    """
    pairs = checkpoint(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = _state(pairs)
    for _ in range(max_rounds):
        old, pairs = pairs, checkpoint(_small_star(_large_star(pairs)))
        release(old)
        before, state = state, _state(pairs)
        if before == state:
            break
    else:
        raise RuntimeError("connected components did not converge")
    roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest node among the node and its neighbours."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
