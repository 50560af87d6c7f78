"""From page references to a document graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import join_url

#: Ids whose versions and links of one URL meet in a task.
SPAN = 1 << 16


def target_urls(links: DataFrame) -> DataFrame:
    """(doc_id, target): references resolved against their page and cut at #; empty and unresolvable ones are left out."""
    found = links.where("href <> ''").select("doc_id", join_url("url", "href").alias("target"))
    return found.where("target IS NOT NULL").select("doc_id", F.substring_index("target", "#", 1).alias("target"))


def resolve_links(targets: DataFrame, docs: DataFrame, resolve: str = "asof") -> DataFrame:
    """Distinct edges (src, dst) from (doc_id, target) and (doc_id, url).

    "asof": the latest document of the URL whose id is not above the linking one's, so links to later pages are lost
    and a link to the page's own URL is a self-loop.  "corpus": the latest document of the URL.

    As-of resolution sorts the versions of a URL and its links together, in ranges of ids, so that a URL with very many
    of either does not meet in one task; a link without a version in its range takes the last of the ranges before.
    """
    if resolve == "corpus":
        latest = docs.groupBy("url").agg(F.max("doc_id").alias("dst"))
        return targets.distinct().join(latest, F.col("target") == F.col("url")).select(F.col("doc_id").alias("src"), "dst").distinct()
    if resolve != "asof":
        raise ValueError(f"resolve: {resolve}")
    wanted = targets.select(F.col("target").alias("url"), F.col("doc_id").alias("at")).distinct()
    versions = docs.select("url", F.col("doc_id").alias("at"), F.col("doc_id").alias("version")).unionByName(wanted.withColumn("version", F.lit(None).cast("long")))
    ranged = versions.withColumn("range", F.floor(F.col("at") / SPAN))
    upto = Window.partitionBy("url", "range").orderBy("at", F.col("version").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ranged.withColumn("dst", F.last("version", ignorenulls=True).over(upto)).where("version IS NULL")
    found = inside.where("dst IS NOT NULL").select("at", "dst")
    left = inside.where("dst IS NULL").select("url", "range", "at")
    seen = ranged.groupBy("url", "range").agg(F.max("version").alias("last"))
    before = Window.partitionBy("url").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of ids
    earlier = seen.select("url", "range", F.max("last").over(before).alias("dst")).where("dst IS NOT NULL")
    older = left.join(earlier, ["url", "range"]).select("at", "dst")
    return found.unionByName(older).select(F.col("at").alias("src"), "dst").distinct()


def out_degree(edges: DataFrame) -> DataFrame:
    """(src, out_degree) of distinct edges."""
    return edges.groupBy("src").agg(F.count("*").alias("out_degree"))
