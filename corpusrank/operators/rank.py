"""Ranked search: one batch job for any number of queries.

score = (base * emphasis * nearness + grams + anchors) * (1 + w pagerank) * (1 + w authority), over the documents that
hold any query word; hidden URLs are left out, ties go to the first query word that found the document, then to the
smaller id, and of documents that share a URL the best counts.

The words of a batch of up to ``LITERALS`` queries are brought to the driver and sent back as literals: the index is
sorted by term, so that the scans read the row groups and pages of these words and no others.  A larger batch is
joined with the index by term.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import grams
from ..plans.config import RankConfig
from .index import Index, is_any, query_terms, query_words

KEYS = ["query_id", "doc_id"]
#: Queries of a batch, and words or grams of it, that become literals.
LITERALS = 4096


def occurrences(asked: DataFrame) -> DataFrame:
    """(query_id, n, term, qtf, places) of (query_id, terms, n): each distinct word with its places in the query."""
    each = asked.select("query_id", "n", F.posexplode("terms").alias("i", "term"))
    return each.groupBy("query_id", "n", "term").agg(F.count("*").alias("qtf"), F.sort_array(F.collect_list("i")).alias("places"))


def local_table(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A few rows as a relation whose size the planner knows, and which it broadcasts without a job of its own."""
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema))


_ASKED = pa.schema([("query_id", pa.int64()), ("terms", pa.list_(pa.string())), ("n", pa.int32())])
_TERMS = pa.schema([("query_id", pa.int64()), ("n", pa.int32()), ("term", pa.string()), ("qtf", pa.int64()), ("places", pa.list_(pa.int32())), ("idf", pa.float64())])
_GRAMS = pa.schema([("query_id", pa.int64()), ("n", pa.int32()), ("gram", pa.string()), ("qtf", pa.int64()), ("count", pa.int64())])
_ANCHORS = pa.schema([("query_id", pa.int64()), ("term", pa.string()), ("weight", pa.float64())])


@dataclass
class Wanted:
    """What a batch of queries looks for, with its weight: terms(query_id, n, term, qtf, places, idf),
    grams(query_id, n, gram, weight), anchors(query_id, term, weight); for a small batch also the words and grams."""

    terms: DataFrame
    grams: DataFrame
    anchors: DataFrame
    literals: tuple[list[str], list[str], list[str]] | None = None

    def read(self, table: DataFrame, column: str, which: int) -> DataFrame:
        """The rows of an index table that the batch needs, where it is small enough to say."""
        return table if self.literals is None else table.where(is_any(column, self.literals[which]))


def wanted(asked: DataFrame, index: Index, config: RankConfig) -> Wanted:
    """The weights of the words and grams of (query_id, terms, n) that the index has."""
    rows = asked.limit(LITERALS + 1).collect()
    words = {t for r in rows for t in r["terms"]}
    every = Counter((r["query_id"], k, "_".join(r["terms"][i : i + k])) for r in rows for k in (2, 3) for i in range(len(r["terms"]) - k + 1))
    if max(len(rows), len(words), len(every)) > LITERALS:
        return _joined_wanted(asked, index, config)
    known = index.statistics_of(words | {g for _, _, g in every})
    spark, terms, anchors = asked.sparkSession, [], []
    for r in rows:
        places: dict[str, list[int]] = {}
        for i, t in enumerate(r["terms"]):
            places.setdefault(t, []).append(i)
        for t, at in places.items():
            if ("term", t) in known:
                terms.append((r["query_id"], r["n"], t, len(at), at, known["term", t]["idf"]))
            if ("anchor", t) in known:
                anchors.append((r["query_id"], t, config.anchor_weight * len(at) * known["anchor", t]["idf"]))
    rarity = "df" if config.gram_stat == "cf" else "docs"
    counted = [(q, k, g, times, known[f"gram{k}", g][rarity]) for (q, k, g), times in every.items() if (f"gram{k}", g) in known]
    by_gram = local_table(spark, counted, _GRAMS).select("query_id", "n", "gram", _gram_weight(index, config))
    return Wanted(
        local_table(spark, terms, _TERMS),
        by_gram,
        local_table(spark, anchors, _ANCHORS),
        ([t[2] for t in terms], [g[2] for g in counted], [x[1] for x in anchors]),
    )


def _gram_weight(index: Index, config: RankConfig) -> Column:
    return (config.gram_weight * F.col("qtf") * F.log(F.lit(index.size) / F.col("count"))).alias("weight")


def _joined_wanted(asked: DataFrame, index: Index, config: RankConfig) -> Wanted:
    """The same for a batch of any size, by joins."""
    words = occurrences(asked)
    every = reduce(DataFrame.unionByName, [asked.select("query_id", F.lit(n).alias("n"), F.explode(grams("terms", n)).alias("gram")) for n in (2, 3)])
    counted = every.groupBy("query_id", "n", "gram").agg(F.count("*").alias("qtf")).withColumn("kind", F.concat(F.lit("gram"), F.col("n")))
    count = F.col("df" if config.gram_stat == "cf" else "docs").alias("count")
    of_gram = index.terms.where("kind LIKE 'gram%'").select("kind", F.col("term").alias("gram"), count)
    of_kind = lambda kind: words.join(index.terms.where(F.col("kind") == kind).select("term", "idf"), "term")
    return Wanted(
        of_kind("term"),
        counted.join(of_gram, ["kind", "gram"]).select("query_id", "n", "gram", _gram_weight(index, config)),
        of_kind("anchor").select("query_id", "term", (config.anchor_weight * F.col("qtf") * F.col("idf")).alias("weight")),
    )


def matches(want: Wanted, index: Index) -> DataFrame:
    """A row for each query, distinct word and document that holds it; words of a query keep their multiplicity in qtf.

    The query side is small, so the planner broadcasts it after seeing its size; postings are read by term.
    """
    return want.terms.join(want.read(index.postings, "term", 0), "term")


#: 1 + ln(tf), 0 where tf is 0; in text, as are the expressions below: a query of one user is planned anew each time, and
#: every column object is a call to the JVM.
_LOG_TF = "CASE WHEN tf > 0 THEN 1 + ln(tf) ELSE 0D END"


def _match_rows(found: DataFrame, config: RankConfig) -> DataFrame:
    """What ``combined`` adds up, of ``matches``.

    A place counts up to m + n - 1 + ``near_slack``, and m is not after a word's own first place: of its places, which
    rise, those that count are among its first n + ``near_slack``, and no more are moved.
    """
    return found.selectExpr(*KEYS, "n", f"qtf * {_LOG_TF} * idf AS s", "CAST(qtf * important_tf AS double) AS e", f"slice(positions, 1, n + {config.near_slack}) AS positions", "places", "0D AS extra")


def _extra_rows(found: DataFrame) -> DataFrame:
    """The same of (query_id, doc_id, score)."""
    return found.selectExpr(*KEYS, "CAST(NULL AS int) AS n", "0D AS s", "0D AS e", "CAST(NULL AS array<int>) AS positions", "CAST(NULL AS array<int>) AS places", "score AS extra")


def combined(rows: DataFrame, config: RankConfig) -> DataFrame:
    """(query_id, doc_id, base, emphasis, nearness, extra, first) of rows from matches, grams and anchors, by one shuffle.

    nearness of a query of several words: m is the first place of any query word in the document; each later word i of
    the query adds ``near_step`` if it stands within ``near_slack`` of m + i; all of them add ``near_all``.
    """
    near = f"size(filter(places, i -> i >= 1 AND exists(positions, p -> abs(p - m - i) <= {config.near_slack})))"
    placed = rows.selectExpr("*", "min(array_min(positions)) OVER (PARTITION BY query_id, doc_id) AS m")
    each = placed.selectExpr(*KEYS, "n", "s", "e", "extra", f"CASE WHEN places IS NOT NULL THEN {near} END AS h", "array_min(places) AS first")
    grouped = each.groupBy(*KEYS).agg(*[F.expr(x) for x in ("sum(s) AS base", "sum(e) AS e", "sum(h) AS h", "sum(extra) AS extra", "max(n) AS n", "min(first) AS first")])
    nearness = f"CASE WHEN n > 1 THEN 1 + {config.near_step}D * h + CASE WHEN h = n - 1 THEN {config.near_all}D ELSE 0D END ELSE 1D END AS nearness"
    return grouped.selectExpr(*KEYS, "base", f"1 + {config.important_weight}D * e AS emphasis", nearness, "extra", "first")


def main_scores(found: DataFrame, config: RankConfig) -> DataFrame:
    """(query_id, doc_id, base, emphasis, nearness, first) of ``matches``."""
    return combined(_match_rows(found, config), config).drop("extra")


def _gram_rows(want: Wanted, index: Index) -> DataFrame:
    return want.grams.join(want.read(index.ngrams, "gram", 1), ["n", "gram"]).selectExpr(*KEYS, "weight * occ AS score")


def _anchor_rows(want: Wanted, index: Index) -> DataFrame:
    return want.anchors.join(want.read(index.anchors, "term", 2), "term").selectExpr(*KEYS, f"weight * {_LOG_TF} AS score")


def gram_scores(want: Wanted, index: Index) -> DataFrame:
    """(query_id, doc_id, score) from the query's word pairs and triples, each occurrence in the document counted."""
    return _gram_rows(want, index).groupBy(*KEYS).agg(F.sum("score").alias("score"))


def anchor_scores(want: Wanted, index: Index) -> DataFrame:
    """(query_id, doc_id, score) from the words of the document's own links."""
    return _anchor_rows(want, index).groupBy(*KEYS).agg(F.sum("score").alias("score"))


def union_scores(parts: list[DataFrame]) -> DataFrame:
    """Sum of (query_id, doc_id, score) parts; ``first`` is the least that any part gives (null: none)."""
    aligned = [p.select(*KEYS, "score", (F.col("first") if "first" in p.columns else F.lit(None).cast("int")).alias("first")) for p in parts]
    return reduce(DataFrame.unionByName, aligned).groupBy(*KEYS).agg(F.sum("score").alias("score"), F.min("first").alias("first"))


def boost(scores: DataFrame, config: RankConfig, pagerank: DataFrame | None = None, hits: DataFrame | None = None) -> DataFrame:
    """Scores times the factors of link analysis; documents that it does not know keep theirs."""
    for signal, column, weight in ((pagerank, "pr", config.pagerank_weight), (hits, "authority", config.authority_weight)):
        if signal is not None:
            others = [c for c in scores.columns if c != "score"]
            scores = scores.join(signal.selectExpr("doc_id", column), "doc_id", "left").selectExpr(*others, f"score * (1 + {weight}D * coalesce({column}, 0D)) AS score")
    return scores


def demote_duplicates(scores: DataFrame, classes: DataFrame, config: RankConfig) -> DataFrame:
    """Scores in which members far below the best of their duplicate class (doc_id, class_id) are cut; documents without
    a class are their own."""
    best = scores.join(classes, "doc_id").groupBy("query_id", "class_id").agg(F.max("score").alias("best"))
    joined = scores.join(classes, "doc_id", "left").join(best, ["query_id", "class_id"], "left")
    low = F.col("score") < config.demote_below * F.greatest(F.col("best"), F.lit(0.0))
    return joined.withColumn("score", F.when(low, F.col("score") * config.demote_factor).otherwise(F.col("score"))).drop("class_id", "best")


def visible(scores: DataFrame, docs: DataFrame) -> DataFrame:
    """Scores with url, without hidden documents."""
    return scores.join(docs.where("NOT hidden").selectExpr("doc_id", "url"), "doc_id")


def best_urls(scores: DataFrame, config: RankConfig) -> DataFrame:
    """(query_id, url, score, first, doc_id): the best visible document of each URL, by one partial aggregation."""
    rounded = scores.selectExpr(*KEYS, "url", f"round(score, {config.digits}) AS score", f"coalesce(first, {1 << 30}) AS first")
    best = rounded.groupBy("query_id", "url").agg(F.expr("min(struct(-score AS minus, first, doc_id)) AS b"))
    return best.selectExpr("query_id", "url", "0D - b.minus AS score", "b.first", "b.doc_id")


def top(best: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id, url, score) of the k best URLs of each query.

    The cut at k is taken in every task before the shuffle (window group limit), so a query that matches a large part
    of the corpus sends k rows from each.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "url", "score")


def rank(scores: DataFrame, config: RankConfig, k: int | None = None) -> DataFrame:
    """``top`` of the best URLs of each query."""
    return top(best_urls(scores, config), k or config.top_k)


def total_counts(best: DataFrame) -> DataFrame:
    """(query_id, total_count): the distinct visible URLs of each query.

    Counts a column that ``top`` needs too, so that both read one shuffle of the best URLs.
    """
    return best.groupBy("query_id").agg(F.count("doc_id").alias("total_count"))


def score_queries(queries: DataFrame, index: Index, config: RankConfig = RankConfig(), pagerank: DataFrame | None = None, hits: DataFrame | None = None, classes: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """(query_id, doc_id, score, first, url) of every visible match."""
    return _scored(query_terms(queries, index.analyzer), index, config, pagerank, hits, classes)


def _scored(asked: DataFrame, index: Index, config: RankConfig, pagerank: DataFrame | None = None, hits: DataFrame | None = None, classes: DataFrame | None = None) -> DataFrame:
    want = wanted(asked, index, config)
    parts = [_match_rows(matches(want, index), config)]
    for which, rows in ((1, _gram_rows), (2, _anchor_rows)):
        if want.literals is None or want.literals[which]:
            parts.append(_extra_rows(rows(want, index)))
    found = combined(reduce(DataFrame.unionByName, parts), config)
    scores = boost(found.selectExpr(*KEYS, "base * emphasis * nearness + extra AS score", "first"), config, pagerank, hits)
    if config.demote_near_dups and classes is not None:
        scores = demote_duplicates(scores, classes, config)
    return visible(scores, index.docs)


def search_many(queries: DataFrame, index: Index, config: RankConfig = RankConfig(), k: int | None = None, **signals: DataFrame | None) -> DataFrame:  # noqa: B008
    """(query_id, rank, doc_id, url, score, total_count) for (query_id, query); a query without a word has no rows."""
    return _ranked(score_queries(queries, index, config, **signals), config, k)


def _ranked(scores: DataFrame, config: RankConfig, k: int | None) -> DataFrame:
    best = best_urls(scores, config)
    return top(best, k or config.top_k).join(total_counts(best), "query_id")


def search(query: str, index: Index, config: RankConfig = RankConfig(), k: int | None = None, **signals: DataFrame | None) -> tuple[list[tuple[str, float]], int]:  # noqa: B008
    """([(url, score)], total count) of one query; ([], 0) if it has no word."""
    terms = query_words(query, index.analyzer)
    if not terms:
        return [], 0
    spark = index.docs.sparkSession
    asked = local_table(spark, [(0, terms, len(terms))], _ASKED)
    # one query needs no window: its rows are counted as they pass into the cut at k
    counted = Observation()
    best = best_urls(_scored(asked, index, config, **signals), config).observe(counted, F.count("*").alias("total"))
    rows = best.orderBy(F.desc("score"), "first", "doc_id").limit(k or config.top_k).select("url", "score").collect()
    return [(r["url"], r["score"]) for r in rows], counted.get["total"]
