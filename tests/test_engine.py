"""Index, ranking, duplicates, links and graphs on small corpora, against brute force and hand-made results."""

from __future__ import annotations

import hashlib
import io
import json
import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusrank.functions import html
from corpusrank.functions.stem import porter
from corpusrank.functions.text import dealt, gram_counts, words
from corpusrank.operators import dedup, graph, index, links, rank
from corpusrank.plans import catalog
from corpusrank.plans.config import BuildConfig, RankConfig
from corpusrank.sources.pages import read_json_tree, read_queries, rejected_pages
from corpusrank.streaming.ingest import ingest

SIMPLE = BuildConfig(analyzer="simple")


def plain(spark, texts, urls=None):
    rows = [(i, urls[i] if urls else f"http://h/{i}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "ord long, url string, content string")


def test_golden_ranking(spark):
    texts = ["data mining data mining tools", "mining of the open data", "open tools", "", "data a b c d e f g h i j k mining"]
    held = index.build_index(plain(spark, texts), SIMPLE, html=False)
    found, total = rank.search("data mining", held)
    assert [(u, round(s, 6)) for u, s in found] == [("http://h/0", 3.663425), ("http://h/1", 1.838972), ("http://h/4", 1.021651)]
    assert total == 3
    assert rank.search("!!!", held) == ([], 0)


def score(docs: dict[int, dict], n: int, q: list[str]) -> dict[int, float]:
    """The ranking formulas, document at a time."""
    df = {t: sum(t in d["tokens"] for d in docs.values()) for t in q}
    adf = {t: sum(t in d["anchor"] for d in docs.values()) for t in q}
    gram = lambda ts, k: ["_".join(ts[i : i + k]) for i in range(len(ts) - k + 1)]
    cf = {g: sum(gram(d["tokens"], k).count(g) for d in docs.values()) for k in (2, 3) for g in gram(q, k)}
    out = {}
    for key, d in docs.items():
        ts = d["tokens"]
        if not any(t in ts for t in q):
            continue
        base = sum((1 + math.log(ts.count(t))) * math.log(n / df[t]) for t in q if t in ts)
        emphasis = 1 + 0.5 * sum(d["important"].count(t) for t in q if t in ts)
        m = min(ts.index(t) for t in q if t in ts)
        hit = [i for i, t in enumerate(q) if i and any(x == t and abs(p - m - i) <= 5 for p, x in enumerate(ts))]
        near = 1.0 if len(q) == 1 else 1 + 0.3 * len(hit) + 0.5 * (len(hit) == len(q) - 1)
        grams = 0.3 * sum(gram(ts, k).count(g) * math.log(n / cf[g]) for k in (2, 3) for g in gram(q, k) if cf[g])
        anchors = 1.5 * sum((1 + math.log(d["anchor"].count(t))) * math.log(n / adf[t]) for t in q if t in d["anchor"])
        out[key] = base * emphasis * near + grams + anchors
    return out


def test_ranking_against_brute_force(spark):
    r = random.Random(5)
    vocabulary = ["running", "cats", "dogs", "apple", "the", "of", "happily", "flies"]
    pages, docs = [], {}
    for i in range(40):
        title, body, link = ([r.choice(vocabulary) for _ in range(r.randint(0, k))] for k in (3, 30, 3))
        pages.append((i, f"http://h/{i}", f"<title>{' '.join(title)}</title><p>{' '.join(body)}</p><a href='/{r.randrange(40)}'>{' '.join(link)}</a>" + f"<!-- {i} -->"))
        stems = lambda ws: [porter(w) for w in ws]
        docs[i] = {"tokens": stems(title + body + link), "important": stems(title), "anchor": stems(link)}
    held = index.build_index(spark.createDataFrame(pages, "ord long, url string, content string"))
    queries = ["running cats", "the the dogs", "of", "flies happily apple", "unknown the", "dogs cats running the of"]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    edges = links.resolve_links(links.target_urls(held.links), held.docs)
    pr = {x["doc_id"]: x["pr"] for x in graph.pagerank(held.docs, edges).collect()}
    hub = {x["doc_id"]: x["authority"] for x in graph.hits(held.docs, edges).collect()}
    signals = {"pagerank": graph.pagerank(held.docs, edges), "hits": graph.hits(held.docs, edges)}
    got = {(x["query_id"], x["doc_id"]): x["score"] for x in rank.score_queries(asked, held, **signals).collect()}
    want = {(k, d): s * (1 + 2.5 * pr[d]) * (1 + 1.5 * hub[d]) for k, q in enumerate(queries) for d, s in score(docs, 40, [porter(w) for w in q.split()]).items()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)


def test_ties_urls_and_totals(spark):
    texts = ["alpha beta", "beta alpha", "gamma", "alpha beta x"]
    held = index.build_index(plain(spark, texts, ["http://h/a#1", "http://h/a#2", "http://h/404", "http://h/b"]), SIMPLE, html=False)
    found, total = rank.search("alpha", held, RankConfig())
    assert [u for u, _ in found] == ["http://h/a", "http://h/b"] and total == 2
    assert rank.search("gamma", held)[1] == 0
    assert len(rank.search("alpha", held, k=1)[0]) == 1


def test_exact_duplicates_and_ids(spark):
    rows = plain(spark, ["b", "a", "b", "", "", "c"])
    kept = index.dense_ids(dedup.first_of_equal(rows)).orderBy("doc_id").collect()
    assert [(x["ord"], x["doc_id"]) for x in kept] == [(0, 0), (1, 1), (3, 2), (5, 3)]
    assert sorted((x["copies"], x["first"]) for x in dedup.duplicate_groups(rows).collect()) == [(2, 0), (2, 3)]


def test_near_pairs_against_brute_force(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(30)]
    values = base + [b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(4)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = spark.createDataFrame(list(enumerate(signed)), "doc_id long, simhash long")
    got = {(x["doc_id"], x["dup_id"], x["hamming"]) for x in dedup.near_pairs(rows).collect()}
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
    want = {(i, j, (a ^ b).bit_count()) for a, i in first.items() for b, j in first.items() if i < j and (a ^ b).bit_count() <= 3}
    assert got == want
    with pytest.raises(ValueError):
        dedup.near_pairs(rows, radius=4)


def test_simhash_of_null_and_wordless(spark):
    rows = spark.createDataFrame([(0, None), (1, ""), (2, "!!"), (3, "a")], "doc_id long, text string")
    assert [x["doc_id"] for x in dedup.text_simhash(rows).collect()] == [3]


def test_links(spark):
    docs = spark.createDataFrame([(0, "u0"), (1, "u1"), (2, "u0"), (3, "u3")], "doc_id long, url string")
    wanted = spark.createDataFrame([(1, "u0"), (3, "u0"), (0, "u1"), (2, "u0"), (3, "u0"), (1, "zz")], "doc_id long, target string")
    assert sorted(map(tuple, links.resolve_links(wanted, docs).collect())) == [(1, 0), (2, 2), (3, 2)]
    assert sorted(map(tuple, links.resolve_links(wanted, docs, "corpus").collect())) == [(0, 1), (1, 2), (2, 2), (3, 2)]
    far = spark.createDataFrame([(10, "u"), (70000, "u"), (200000, "u")], "doc_id long, url string")
    wanted = spark.createDataFrame([(5, "u"), (11, "u"), (69999, "u"), (140000, "u"), (900000, "u")], "doc_id long, target string")
    assert sorted(map(tuple, links.resolve_links(wanted, far).collect())) == [(11, 10), (69999, 10), (140000, 70000), (900000, 200000)]


def test_graph_goldens(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "doc_id long")
    edges = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (3, 3)], "src long, dst long")
    ranks = lambda **k: [round(x["pr"], 6) for x in graph.pagerank(nodes, edges, **k).orderBy("doc_id").collect()]
    assert ranks(max_iter=1, tol=None) == [0.35625, 0.14375, 0.0375, 0.25]
    assert ranks() == pytest.approx([0.098859, 0.053437, 0.0375, 0.25], abs=2e-6)
    both = lambda **k: [(round(x["hub"], 6), round(x["authority"], 6)) for x in graph.hits(nodes, edges, **k).orderBy("doc_id").collect()]
    assert both(max_iter=1, tol=None) == [(0.0, 0.816497), (0.534522, 0.408248), (0.801784, 0.0), (0.267261, 0.408248)]
    assert both(max_iter=5, tol=None) == [(0.0, 0.850633), (0.525735, 0.525672), (0.850628, 0.0), (0.005907, 0.009558)]


def test_steps_do_not_shuffle_edges(spark):
    r = random.Random(8)
    nodes = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    edges = spark.createDataFrame(sorted({(r.randrange(60), r.randrange(60)) for _ in range(400)}), "src long, dst long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        held, ranks = graph._held(edges.withColumn("w", graph.F.lit(0.5)), "src"), nodes.withColumn("pr", graph.F.lit(1 / 60))
        held.count()
        for _ in range(3):
            ranks = graph._rank_step(held, ranks, nodes, 0.85, 60)
        plan = ranks._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        exchanges = [x for x in plan.splitlines() if " Exchange " in x]
        assert exchanges and not any("src" in x for x in exchanges)
        held.unpersist()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_boosts_keep_unknown_documents(spark):
    scores = spark.createDataFrame([(0, 1, 2.0), (0, 2, 3.0)], "query_id long, doc_id long, score double")
    known = spark.createDataFrame([(1, 0.5, 0.25)], "doc_id long, pr double, authority double")
    got = {x["doc_id"]: x["score"] for x in rank.boost(scores, RankConfig(), known, known).collect()}
    assert got == {1: 2.0 * (1 + 2.5 * 0.5) * (1 + 1.5 * 0.25), 2: 3.0}


def test_searches_read_their_words_only(spark, tmp_path):
    texts = [f"word{i % 50} word{i % 7} common" for i in range(200)]
    index.build_index(plain(spark, texts), SIMPLE, html=False).write(str(tmp_path / "index"))
    held = index.read_index(spark, str(tmp_path / "index"))
    queries = spark.createDataFrame([(0, "word3 word5"), (1, "common nowhere")], "query_id long, query string")
    want = rank.wanted(index.query_terms(queries, "simple"), held, RankConfig())
    for table, column, which, test in ((held.postings, "term", 0, "In(term, [common,word3,word5])"), (held.ngrams, "gram", 1, "gram")):
        plan = want.read(table, column, which)._jdf.queryExecution().executedPlan().toString()
        assert test in plan.split("PushedFilters:")[1]
    rank_all = lambda: sorted(map(tuple, rank.search_many(queries, held).collect()))
    few = rank_all()
    limit, rank.LITERALS = rank.LITERALS, 0
    try:
        assert rank_all() == few and few
    finally:
        rank.LITERALS = limit
    many = index.is_any("term", [f"word{i}" for i in range(35)])
    assert held.postings.where(many).select("term").distinct().count() == 35


def test_empty_graph(spark):
    nodes, edges = spark.createDataFrame([(0,), (1,)], "doc_id long"), spark.createDataFrame([], "src long, dst long")
    assert [x["pr"] for x in graph.pagerank(nodes, edges).collect()] == pytest.approx([0.075, 0.075])
    assert {(x["hub"], x["authority"]) for x in graph.hits(nodes, edges).collect()} == {(0.0, 0.0)}
    assert graph.pagerank(nodes.where("false"), edges).count() == 0


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    for name, content in (("a.json", {"url": "http://h/a#x", "content": "<p>one two</p>"}), ("deep/b.JSON", {"content": "<p>three</p>"}), ("c.json", {"url": "http://h/c"}), ("d.txt", {"url": "no"})):
        (tmp_path / "in" / name).write_text(json.dumps(content))
    (tmp_path / "in/bad.json").write_text("{not json")
    return tmp_path


def test_json_tree(spark, tree):
    rows = {x["path"].rsplit("/", 1)[1]: (x["url"], x["content"]) for x in read_json_tree(spark, str(tree / "in")).collect()}
    assert set(rows) == {"a.json", "b.JSON", "c.json"}
    assert rows["a.json"] == ("http://h/a#x", "<p>one two</p>") and rows["c.json"][1] == "" and rows["b.JSON"][0].endswith("b.JSON")
    assert [x["record"] for x in rejected_pages(spark, str(tree / "in")).collect()] == ["{not json"]


def test_query_file(spark, tmp_path):
    (tmp_path / "q.txt").write_text("one two\n\n  three \r\n")
    assert [x["query"] for x in read_queries(spark, str(tmp_path / "q.txt")).orderBy("query_id").collect()] == ["one two", "three"]


def test_build_write_search(spark, tree, capsys, monkeypatch):
    from corpusrank import cli

    cli.build(spark, str(tree / "in"), str(tree / "index"))
    engine = cli.Engine(spark, str(tree / "index"))
    found = engine.search_json(" Two ")
    assert [x["url"] for x in found["results"]] == ["http://h/a"] and found["total_count"] == found["count"] == 1
    assert engine.search_json("") == {"results": [], "time": 0, "count": 0}
    (tree / "q.txt").write_text("two\nthree\n")
    found = engine.bench(str(tree / "q.txt"))
    assert found["queries"] == 2 and [(x["query"], x["num_results"]) for x in found["each"]] == [("two", 1), ("three", 1)]
    cli.report(found)
    lines = capsys.readouterr().out.splitlines()
    assert lines[0].startswith(("[PASS] Query  1: two", "[FAIL] Query  1: two")) and "Queries under 300ms:" in lines[-1] and "|     1 results |" in lines[1]
    page = engine.page("two")
    assert page["stats"].startswith("About 1 results (") and page["results"][0]["title"] == "h" and page["results"][0]["display_url"] == "h/a"
    assert page["results"][0]["relevance"] == f"{engine.search('two')[0][0][1]:.2f}" and engine.page("nowhere") == {"stats": "", "results": []}
    monkeypatch.setattr("sys.stdin", io.StringIO("two\nboom\nthree\nquit\ntwo\n"))
    plain_search = engine.search
    engine.search = lambda q: plain_search(q) if q != "boom" else 1 / 0
    cli.interactive(engine)
    engine.search = plain_search
    said = capsys.readouterr().out
    assert said.count("Query: ") == 4 and said.count("Found 1 results") == 2 and "Error: division by zero" in said
    urls_of = {k: v for x in index.export_doc_index(engine.index.docs).collect() for k, v in json.loads(x["value"]).items()}
    assert urls_of == {str(x["doc_id"]): x["url"] for x in engine.index.docs.collect()}
    cli.show(*engine.search("two"))
    assert "1. [" in capsys.readouterr().out
    stats = index.index_stats(spark, engine.index, str(tree / "index")).first()
    assert (stats["num_documents"], stats["num_unique_terms"]) == (3, 3) and stats["index_size_kb"] > 0
    assert index.export_tsv(engine.index.postings).where("value LIKE 'two\t%'").count() == 1


def test_streaming_ingest_is_idempotent(spark, tree):
    run = lambda: ingest(spark, str(tree / "in"), str(tree / "out"), str(tree / "check")).awaitTermination()
    run()
    assert spark.read.parquet(str(tree / "out")).count() == 3
    (tree / "in/again.json").write_text(json.dumps({"url": "http://h/z", "content": "<p>one two</p>"}))
    (tree / "in/new.json").write_text(json.dumps({"url": "http://h/n", "content": "<p>new</p>"}))
    run()
    run()
    rows = spark.read.parquet(str(tree / "out"))
    assert rows.count() == 4 == rows.select("content_md5").distinct().count()


def test_an_index_of_what_is_asked_answers_like_the_whole_one(spark):
    r = random.Random(11)
    texts = [" ".join(r.choices(["alpha", "beta", "gamma", "delta", "rare"], k=r.choice([0, 1, 2, 30]))) for _ in range(60)]
    none = F.array().cast("array<string>")
    parsed = plain(spark, texts).select(F.col("ord").alias("doc_id"), "url", dedup.content_hash().alias("content_md5"), words("content").alias("tokens"), none.alias("important"), none.alias("anchor"), none.alias("hrefs"))
    queries = ["alpha beta gamma", "rare", "beta beta", "missing alpha", "!!!"]
    some = index.index_asked(parsed, "simple", [index.query_words(q, "simple") for q in queries])
    every = index.index_documents(parsed, "simple")
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    a, b = (sorted(tuple(x) for x in rank.search_many(asked, held, RankConfig(digits=6), 100).collect()) for held in (some, every))
    assert a == b and a
    of = lambda held, *c: sorted(tuple(x) for x in held.postings.where(F.col("term").isin("alpha", "beta", "gamma", "rare")).select(*c).collect())
    columns = ("term", "doc_id", "tf", "important_tf", "positions")
    assert of(some, *columns) == of(every, *columns)
    assert {x["term"] for x in some.postings.select("term").distinct().collect()} == {"alpha", "beta", "gamma", "rare"}
    assert some.size == every.size == 60


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_words_are_counted_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "b"], ["a", "a", "z"]), (2, [], ["q"]), (3, None, None), (4, ["a"], [])], "doc_id long, tokens array<string>, important array<string>")
    posted = index.document_postings(docs.where("tokens IS NOT NULL"))
    assert sorted(tuple(x) for x in posted.collect()) == [("a", 1, 1, 2, [1]), ("a", 4, 1, 0, [0]), ("b", 1, 2, 0, [0, 2])]
    assert sorted(tuple(x) for x in index.term_frequency(docs).collect()) == [(1, "a", 1), (1, "b", 2), (4, "a", 1)]
    assert sorted(tuple(x) for x in index.ngrams(docs, 2).collect()) == [(2, "a_b", 1, 1), (2, "b_a", 1, 1)]
    assert [_exchanges(x) for x in (posted, index.term_frequency(docs), index.ngrams(docs, 2))] == [0, 0, 0]


def test_votes_are_all_that_fingerprints_shuffle(spark):
    texts = [" ".join(f"w{i % k}" for i in range(k * 3 + 1)) for k in range(1, 30)]
    found = dedup.text_simhash(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert _exchanges(found) == 1

    def brute(text: str) -> int:
        hashes = [int(hashlib.md5(w.encode()).hexdigest()[16:], 16) for w in text.split()]
        return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))

    assert {x["doc_id"]: x["simhash"] % (1 << 64) for x in found.collect()} == {i: brute(t) for i, t in enumerate(texts)}


def test_statistics_need_no_written_index(spark, monkeypatch):
    monkeypatch.setattr(index, "checkpoint", lambda df: pytest.fail("written"))
    none = F.array().cast("array<string>")
    parsed = plain(spark, ["a b a", "", "b c"]).select(F.col("ord").alias("doc_id"), "url", dedup.content_hash().alias("content_md5"), words("content").alias("tokens"), none.alias("important"), none.alias("anchor"), none.alias("hrefs"))
    assert tuple(index.index_stats(spark, index.index_documents(parsed, "simple", written=False)).first()) == (3, 3, 0.0)


def test_grams_are_counted_by_place(spark):
    texts = [["a", "b", "a", "b"], ["a"], [], None, ["b", "a", "b"]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, tokens array<string>")
    assert dict(tuple(x) for x in gram_counts(docs, 2).collect()) == {"a_b": 3, "b_a": 2}
    assert dealt(docs.select("doc_id")).rdd.getNumPartitions() == 4
    assert dict(tuple(x) for x in gram_counts(docs, 3).collect()) == {"a_b_a": 1, "b_a_b": 2}


def test_pages_are_parsed_in_chunks(spark):
    page = "<h1>Big</h1> <a href='/x'>link</a> " + "w " * 400_000
    pages = spark.createDataFrame([(i, None if i == 2 else page if i < 5 else "<b>small") for i in range(8)], "doc_id long, content string").coalesce(1)
    got = {x["doc_id"]: x for x in html.extract_pages(pages, lists=("important", "tokens")).collect()}
    assert [len(got[i]["tokens"]) for i in range(8)] == [400_002, 400_002, 0, 400_002, 400_002, 1, 1, 1]
    assert [got[i]["important"] for i in (0, 2, 7)] == [["big"], [], ["small"]]
    assert set(got[0].asDict()) == {"doc_id", "important", "tokens"}
    batch = pa.RecordBatch.from_pydict({"content": ["x" * n for n in (700_000, 700_000, 10, 3_000_000, 10)]})
    assert [part.num_rows for part in html._chunks(batch, "content")] == [1, 2, 1, 1]


def test_an_index_of_what_is_asked_counts_once(spark):
    none = F.array().cast("array<string>")
    parsed = plain(spark, ["alpha beta alpha beta", "beta"]).select(F.col("ord").alias("doc_id"), "url", dedup.content_hash().alias("content_md5"), words("content").alias("tokens"), none.alias("important"), none.alias("anchor"), none.alias("hrefs"))
    held = index.index_asked(parsed, "simple", [["alpha", "beta"]])
    for counted, rows in ((held.postings, 3), (held.ngrams, 1)):
        plan = counted._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Aggregate" not in plan and counted.count() == rows


def test_results_by_url_need_no_order(spark, data):
    plan = catalog.QUERIES["url_result_dedup"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "Window [rank" not in plan


def test_votes_are_counted_a_piece_at_a_time(spark):
    r = random.Random(4)
    texts = [r.choice([None, "", "é!", "Word", " ".join(r.choices(["The", "a1", "xé", "b_c", "zZ9"], k=r.choice([1, 254, 255, 256, 3000])))]) for _ in range(60)]
    found = dedup.text_simhash(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "sort_array" not in plan

    def brute(words: list[str]) -> int:
        hashes = [int(hashlib.md5(w.encode()).hexdigest()[16:], 16) for w in words]
        return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))

    split = {i: [w.lower() for w in re.findall("[A-Za-z0-9]+", t or "")] for i, t in enumerate(texts)}
    assert {x["doc_id"]: x["simhash"] % (1 << 64) for x in found.collect()} == {i: brute(w) for i, w in split.items() if w}


def test_an_index_of_what_is_asked_reads_texts_and_lists_alike(spark):
    r = random.Random(12)
    some = lambda k: r.choices(["alpha", "beta", "gamma", "delta"], k=r.choice([0, 1, k]))
    rows = [(i, f"http://h/{i}", "x", None if i == 3 else "-É ".join(some(40)).title(), some(4), some(4)) for i in range(80)]
    parsed = spark.createDataFrame(rows, "doc_id long, url string, content_md5 string, text string, important array<string>, anchor array<string>").withColumn("tokens", words("text")).withColumn("hrefs", F.array().cast("array<string>"))
    queries = ["alpha beta gamma", "beta beta", "missing alpha", "!!!"]
    asked = [index.query_words(q, "simple") for q in queries]
    every, lists, texts = index.index_documents(parsed, "simple"), index.index_asked(parsed.drop("text"), "simple", asked), index.index_asked(parsed, "simple", asked)
    terms, grams = ["alpha", "beta", "gamma"], ["alpha_beta", "beta_gamma", "alpha_beta_gamma", "beta_beta"]
    for name, column, wanted in (("postings", "term", terms), ("anchors", "term", terms), ("ngrams", "gram", grams)):
        whole, a, b = (sorted(tuple(x) for x in getattr(i, name).where(F.col(column).isin(*wanted)).select(*sorted(every.tables()[name].columns)).collect()) for i in (every, lists, texts))
        assert whole == a == b and a
        assert getattr(texts, name).where(~F.col(column).isin(*wanted)).count() == 0
    made = texts.postings._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in made and texts.size == 80
    assert index.index_asked(parsed, "simple", [[]]).postings.count() == 0


def test_only_places_that_can_count_are_moved(spark):
    found = spark.createDataFrame([(0, 1, 2, "a", 1, 9, 0, 0.5, list(range(0, 900, 3)), [1])], "query_id long, doc_id long, n int, term string, qtf long, tf long, important_tf long, idf double, positions array<int>, places array<int>")
    assert rank._match_rows(found, RankConfig()).first()["positions"] == [0, 3, 6, 9, 12, 15, 18]


def test_a_batch_of_pages_is_given_up_before_the_next():
    before, held = pa.total_allocated_bytes(), []

    def batches():
        for _ in range(3):
            held.append(pa.total_allocated_bytes() - before)
            yield pa.RecordBatch.from_pydict({"doc_id": [1, 2], "content": ["<b>x</b>" + " " * 4_000_000] * 2})

    assert sum(part.num_rows for part in html._read(batches(), "content", ["doc_id"], ("important",))) == 6
    assert max(held) < 1_000_000
