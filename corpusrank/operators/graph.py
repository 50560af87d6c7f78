"""Link analysis: iterations over edge DataFrames, cut by checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint, release
from .links import out_degree

#: Steps between two checkpoints where no convergence test needs a result earlier.
EVERY = 5


def _held(edges: DataFrame, key: str) -> DataFrame:
    """Edges dealt by one end and kept so, in memory or on disk: no step shuffles them again.

    What an executor loses is dealt again from the written edges.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.repartition(parts, key).persist()


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, max_iter: int = 100, tol: float | None = 1e-6, size: int | None = None) -> DataFrame:
    """(doc_id, pr): rank (1 - damping) / N plus damped shares of the pages that link to it; dangling rank is dropped.

    Stops after the step whose L1 change is below ``tol``, which it keeps; ``tol`` None makes exactly ``max_iter``
    steps.  Edges are dealt by source once; each step shuffles ranks and partial sums alone.
    """
    n = nodes.count() if size is None else size
    nodes = nodes.select("doc_id")
    if n == 0:
        return nodes.withColumn("pr", F.lit(0.0)).where("false")
    written = checkpoint(edges.join(out_degree(edges), "src").select("src", "dst", (1.0 / F.col("out_degree")).alias("w")))
    held, ranks, table = _held(written, "src"), nodes.withColumn("pr", F.lit(1.0 / n)), None
    for step in range(max_iter):
        # ranks before the step are looked at again only where they were written: a plan of several steps would double with each
        base = nodes if tol is None else ranks.select("doc_id", F.col("pr").alias("before"))
        ranks = _rank_step(held, ranks, base, damping, n)
        if tol is None and step % EVERY < EVERY - 1 and step < max_iter - 1:
            continue
        old, table = table, checkpoint(ranks)
        release(old)
        ranks = table.select("doc_id", "pr")
        if tol is not None and table.agg(F.sum(F.abs(F.col("pr") - F.col("before")))).first()[0] < tol:
            break
    held.unpersist()
    release(written)
    return ranks


def _rank_step(held: DataFrame, ranks: DataFrame, base: DataFrame, damping: float, n: int) -> DataFrame:
    """``base`` (doc_id, ...), which has every node, with pr after one step."""
    inflow = held.join(ranks.select("doc_id", "pr"), F.col("src") == F.col("doc_id")).groupBy("dst").agg(F.sum(F.col("pr") * F.col("w")).alias("inflow"))
    fresh = (1 - damping) / n + damping * F.coalesce("inflow", F.lit(0.0))
    return base.join(inflow, F.col("doc_id") == F.col("dst"), "left").select(*base.columns, fresh.alias("pr"))


def l1_distance(a: DataFrame, b: DataFrame, column: str, key: str = "doc_id") -> float:
    """Sum of absolute differences of two vectors over the same keys."""
    pair = a.select(key, F.col(column).alias("x")).join(b.select(key, F.col(column).alias("y")), key)
    return pair.agg(F.coalesce(F.sum(F.abs(F.col("x") - F.col("y"))), F.lit(0.0))).first()[0]


def l2_norm(vector: DataFrame, column: str) -> DataFrame:
    """One row, ``norm``: the square root of the sum of squares, 1 if that is 0."""
    total = F.sqrt(F.coalesce(F.sum(F.col(column) * F.col(column)), F.lit(0.0)))
    return vector.agg(total.alias("norm")).select(F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0).alias("norm"))


def hits(nodes: DataFrame, edges: DataFrame, max_iter: int = 100, tol: float | None = 1e-6) -> DataFrame:
    """(doc_id, hub, authority): authorities from the hubs before, hubs from the new authorities, each of L2 norm 1.

    Stops after the step in which both L1 changes are below ``tol``; ``tol`` None makes exactly ``max_iter`` steps.
    Without edges all are 0.  Edges are dealt by either end once; a step shuffles scores and partial sums alone.  Both
    scores are normalised after the step, as the hubs' sums of authorities only grow by the authorities' norm.
    """
    nodes = nodes.select("doc_id")
    written = checkpoint(edges.select("src", "dst"))
    by_src, by_dst = _held(written, "src"), _held(written, "dst")
    state, table = nodes.select("doc_id", F.lit(1.0).alias("hub"), F.lit(1.0).alias("authority")), None
    for _ in range(max_iter):
        into = by_src.join(state.select("doc_id", "hub"), F.col("src") == F.col("doc_id")).groupBy("dst").agg(F.sum("hub").alias("s"))
        raw = state.select("doc_id", F.col("hub").alias("hub_before"), F.col("authority").alias("authority_before")).join(into, F.col("doc_id") == F.col("dst"), "left").select("doc_id", "hub_before", "authority_before", F.coalesce("s", F.lit(0.0)).alias("authority"))
        out = by_dst.join(raw.select("doc_id", "authority"), F.col("dst") == F.col("doc_id")).groupBy("src").agg(F.sum("authority").alias("s"))
        old, table = table, checkpoint(raw.join(out, F.col("doc_id") == F.col("src"), "left").select("doc_id", "hub_before", "authority_before", "authority", F.coalesce("s", F.lit(0.0)).alias("hub")))
        release(old)
        norm = table.agg(*[F.sqrt(F.coalesce(F.sum(F.col(c) * F.col(c)), F.lit(0.0))).alias(c) for c in ("hub", "authority")]).first()
        scaled = {c: F.col(c) / F.lit(norm[c] if norm[c] > 0 else 1.0) for c in ("hub", "authority")}
        state = table.select("doc_id", scaled["hub"].alias("hub"), scaled["authority"].alias("authority"))
        if tol is not None:
            moved = table.agg(*[F.coalesce(F.sum(F.abs(scaled[c] - F.col(f"{c}_before"))), F.lit(0.0)).alias(c) for c in scaled]).first()
            if max(moved) < tol:
                break
    by_src.unpersist()
    by_dst.unpersist()
    release(written)
    return state
