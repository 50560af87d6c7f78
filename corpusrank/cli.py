"""Command line: ``python -m corpusrank.cli build | search | bench | stats | export``.

A web front end is not part of this engine: ``Engine.search_json`` and ``Engine.page`` give what it would show.
"""

from __future__ import annotations

import argparse
import json
import sys
import time

import pyarrow as pa
from pyspark.sql import SparkSession

from .functions import format, urls
from .operators import dedup, graph, links, rank
from .operators.index import Index, build_index, export_doc_index, export_tsv, index_stats, read_index
from .plans.config import BuildConfig, RankConfig
from .sources.pages import read_json_tree, read_queries

SLOW_MS = 300


def build(spark: SparkSession, corpus: str, out: str, config: BuildConfig = BuildConfig()) -> Index:  # noqa: B008
    """Index a tree of JSON pages (in the order of their paths) and write index, graph and near-duplicates to ``out``."""
    pages = read_json_tree(spark, corpus).withColumnRenamed("path", "ord")
    built = build_index(pages, config)
    built.write(out)
    built.release()
    index = read_index(spark, out)
    edges = links.resolve_links(links.target_urls(index.links), index.docs, config.resolve)
    edges.write.mode("overwrite").parquet(f"{out}/edges")
    edges = spark.read.parquet(f"{out}/edges")
    graph.pagerank(index.docs, edges, config.damping, config.max_iterations, config.tolerance, index.size).write.mode("overwrite").parquet(f"{out}/pagerank")
    graph.hits(index.docs, edges, config.max_iterations, config.tolerance).write.mode("overwrite").parquet(f"{out}/hits")
    hashes = dedup.simhash64(index.postings)
    dedup.fingerprint_classes(hashes).write.mode("overwrite").parquet(f"{out}/near_classes")
    dedup.near_pairs(hashes, config.near_radius).write.mode("overwrite").parquet(f"{out}/near_pairs")
    return index


class Engine:
    """A written index with its link analysis; what is known of each document is held in memory between queries."""

    def __init__(self, spark: SparkSession, path: str, config: RankConfig = RankConfig()) -> None:  # noqa: B008
        self.spark, self.path, self.config = spark, path, config
        self.index = read_index(spark, path).persist()
        self.signals = {"pagerank": spark.read.parquet(f"{path}/pagerank").persist(), "hits": spark.read.parquet(f"{path}/hits").persist()}

    def search(self, query: str, k: int = 10) -> tuple[list[tuple[str, float]], float, int]:
        """(results, milliseconds, total count)."""
        start = time.perf_counter()
        found, total = rank.search(query, self.index, self.config, k, **self.signals)
        return found, (time.perf_counter() - start) * 1000, total

    def search_json(self, query: str, k: int = 20) -> dict:
        """What a web front end answers with."""
        query = query.strip()
        if not query:
            return {"results": [], "time": 0, "count": 0}
        found, took, total = self.search(query, k)
        return {"results": [{"url": u, "score": round(s, 4)} for u, s in found], "time": round(took, 2), "count": len(found), "total_count": total, "query": query}

    def page(self, query: str, k: int = 20) -> dict:
        """What a result page shows: a line above, and url, title, display_url, snippet and relevance of each result."""
        answer = self.search_json(query, k)
        if not answer["results"]:
            return {"stats": "", "results": []}
        schema = pa.schema([("place", pa.int64()), ("url", pa.string()), ("score", pa.float64()), ("ms", pa.float64())])
        rows = rank.local_table(self.spark, [(i, x["url"], x["score"], float(answer["time"])) for i, x in enumerate(answer["results"])], schema)
        shown = rows.select("place", "url", urls.page_title().alias("title"), urls.display_url().alias("display_url"), urls.snippet().alias("snippet"), format.shown_score("score").alias("relevance"), format.shown_time("ms").alias("ms")).collect()
        shown.sort(key=lambda r: r["place"])
        return {"stats": f"About {answer['count']} results ({shown[0]['ms']} ms)", "results": [{c: r[c] for c in ("url", "title", "display_url", "snippet", "relevance")} for r in shown]}

    def bench(self, path: str) -> dict:
        """Latency of the queries of a file: each with its count and whether it stays under the limit, total and mean milliseconds, and how many do."""
        each = []
        for query in (r["query"] for r in read_queries(self.spark, path).orderBy("query_id").collect()):
            _, took, total = self.search(query)
            each.append({"query": query, "num_results": total, "time_ms": took, "status": "PASS" if took < SLOW_MS else "FAIL"})
        total = sum(x["time_ms"] for x in each)
        return {"queries": len(each), "total_ms": total, "mean_ms": total / len(each) if each else 0.0, "under_limit": sum(x["status"] == "PASS" for x in each), "each": each}


def report(found: dict) -> None:
    """Print what ``Engine.bench`` found, a line for each query."""
    for i, x in enumerate(found["each"], 1):
        print(f"[{x['status']}] Query {i:2d}: {x['query'][:40]:<40} | {x['num_results']:5d} results | {x['time_ms']:6.2f}ms")
    print(f"Total queries: {found['queries']}")
    print(f"Total time: {found['total_ms']:.2f}ms")
    print(f"Average time: {found['mean_ms']:.2f}ms")
    print(f"Queries under {SLOW_MS}ms: {found['under_limit']}/{found['queries']}")


def show(results: list[tuple[str, float]], took: float, total: int) -> None:
    print(f"Found {total} results (showing top {len(results)}, took {took:.2f} ms)")
    for i, (url, score) in enumerate(results, 1):
        print(f"{i}. [{score:.4f}] {url}")


def interactive(engine: Engine) -> None:
    """Ask for queries until an empty line, quit, exit or the end of the input; a query that fails is reported, and the next one asked for."""
    while True:
        print("Query: ", end="", flush=True)
        line = sys.stdin.readline()
        query = line.strip()
        if not query or query.lower() in ("quit", "exit"):
            break
        try:
            show(*engine.search(query))
        except Exception as failed:
            print(f"Error: {failed}")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpusrank")
    parser.add_argument("command", choices=("build", "search", "bench", "stats", "export"))
    parser.add_argument("--corpus")
    parser.add_argument("--index", required=True)
    parser.add_argument("--query")
    parser.add_argument("--queries")
    parser.add_argument("--out")
    parser.add_argument("--top", type=int, default=10)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("corpusrank").getOrCreate()
    if given.command == "build":
        if not given.corpus:
            parser.error("build needs --corpus")
        build(spark, given.corpus, given.index)
    if given.command in ("build", "stats"):
        print(json.dumps(index_stats(spark, read_index(spark, given.index), given.index).first().asDict()))
    elif given.command == "search":
        engine = Engine(spark, given.index)
        if given.query is None:
            interactive(engine)
        else:
            show(*engine.search(given.query, given.top))
    elif given.command == "bench":
        if not given.queries:
            parser.error("bench needs --queries")
        report(Engine(spark, given.index).bench(given.queries))
    elif given.command == "export":
        if not given.out:
            parser.error("export needs --out")
        index = read_index(spark, given.index)
        export_doc_index(index.docs).write.mode("overwrite").text(f"{given.out}/doc_index")
        export_tsv(index.postings).write.mode("overwrite").text(f"{given.out}/postings")
    return 0


if __name__ == "__main__":
    sys.exit(main())
