"""Words, stems, markup and URLs against hand-made results."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusrank.functions import format, stem, text, urls
from corpusrank.functions.format import shown_time
from corpusrank.functions.html import page_words
from corpusrank.functions.stem import porter, stem_terms


@pytest.mark.parametrize("word,stem", [
    ("running", "run"), ("skies", "sky"), ("dying", "die"), ("news", "news"), ("deeped", "deep"), ("is", "is"), ("flies", "fli"), ("dies", "die"),
    ("died", "die"), ("enjoy", "enjoy"), ("happy", "happi"), ("generalizations", "gener"), ("oscillators", "oscil"), ("relational", "relat"),
    ("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("sing", "sing"), ("conflated", "conflat"),
    ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("filing", "file"), ("conditional", "condit"), ("vietnamization", "vietnam"),
    ("formalize", "formal"), ("hopeful", "hope"), ("goodness", "good"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("roll", "roll"), ("2go", "2go"),
])
def test_stems(word, stem):
    assert porter(word) == stem


def test_words(spark):
    rows = spark.createDataFrame([(1, "Café-Bar 2Go"), (2, "!!!"), (3, ""), (4, None), (5, "İstanbul \u212a")], "id int, t string")
    found = {r.id: r.w for r in rows.select("id", text.words("t").alias("w")).collect()}
    assert found == {1: ["caf", "bar", "2go"], 2: [], 3: [], 4: [], 5: ["stanbul"]}


def test_grams(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a", "b"]), (2, ["a"]), (3, [])], "id int, t array<string>")
    found = {r.id: (r.two, r.three) for r in rows.select("id", text.grams("t", 2).alias("two"), text.grams("t", 3).alias("three")).collect()}
    assert found == {1: (["a_b", "b_a", "a_b"], ["a_b_a", "b_a_b"]), 2: ([], []), 3: ([], [])}


def test_vocabulary_stems(spark):
    rows = spark.createDataFrame([(1, "running"), (1, "runs"), (2, None)], "id int, term string")
    assert sorted(map(tuple, stem_terms(rows).collect()), key=str) == [(1, "run"), (1, "run"), (2, None)]


def test_page_words():
    tokens, important, anchor, hrefs = page_words("<title>T</title><h1><b>x</b></h1>a<b>b</b>")
    assert (tokens, sorted(important)) == (["t", "x", "a", "b"], ["b", "t", "x", "x"])
    assert page_words("<p><b>one<br><p>two</p></p>three")[1] == ["one", "two"]
    assert page_words("<p>a<script>var x='</p>';</script>b<!-- c --><style>d</style><template><i>e</i></template></p>")[0] == ["a", "b"]
    tokens, _, anchor, hrefs = page_words('<a href="/x#y">One <b>two</b></a><a>three</a><a href>four</a><a href="1" href="2">five</a>')
    assert (anchor, hrefs) == (["one", "two", "four", "five"], ["/x#y", "2"])
    assert page_words("") == page_words(None) == ([], [], [], [])
    assert page_words("a &amp; b&eacute;c <![CDATA[d]]> <b>e")[0][:2] == ["a", "b"]
    assert page_words("<title>a</title><title>b</title>")[1] == ["a"]


def test_urls(spark):
    hidden = ["http://h/404", "http://h/troubleshooting", "http://h/a.PY?x=1", "http://h/~a?q=/.py", "http://site.pl", "", None]
    shown = ["http://h/python", "http://h/a.html"]
    rows = spark.createDataFrame([(u,) for u in hidden + shown], "url string")
    assert [r[0] for r in rows.select(urls.is_hidden("url")).collect()] == [True] * len(hidden) + [False] * len(shown)
    titles = {"http://www.a.org": "a.org", "http://www.a.org/2020/11": "A - ORG", "http://a.org/big-news_item.HTML": "Big News Item", "http://a.org/x/9": "A - ORG", "http://a.org/about/9/": "About", "no url": "no url"}
    rows = spark.createDataFrame([(u,) for u in titles], "url string")
    assert [r[0] for r in rows.select(urls.page_title("url")).collect()] == list(titles.values())


def test_join_url(spark):
    rows = spark.createDataFrame([("http://h/a/b", "c"), ("http://h/a/b", "/d#e"), ("http://h/a", "http://[bad"), ("http://h/a", "")], "u string, h string")
    assert [r[0] for r in rows.select(urls.join_url("u", "h")).collect()] == ["http://h/a/c", "http://h/d#e", None, "http://h/a"]


def test_scoring_expressions(spark):
    row = spark.range(1).select(text.log_tf(F.lit(0)), text.log_tf(F.lit(1)), text.idf(10, F.lit(0)), text.idf(10, F.lit(10)), text.idf(10, F.lit(20))).first()
    assert row[:4] == (0.0, 1.0, 0.0, 0.0) and row[4] < 0


def test_a_cluster_needs_a_shared_folder(tmp_path):
    from types import SimpleNamespace

    from corpusrank.plans import lineage

    def session(master, folder):
        context = SimpleNamespace(applicationId="app-test", master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: folder))

    assert lineage.checkpoint_dir(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y/corpusrank-app-test"
    assert lineage.checkpoint_dir(session("local[4]", None)).endswith("corpusrank-app-test")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]"):
        with pytest.raises(RuntimeError):
            lineage.checkpoint_dir(session(master, None))


def test_core_queries_survive_a_missing_dependency():
    import subprocess
    import sys

    hide = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; assert 'search_batch' in e.queries() and not any(q.startswith('op1_') for q in e.queries())"
    assert subprocess.run([sys.executable, "-W", "ignore", "-c", hide], cwd=__file__.rsplit("/", 2)[0], capture_output=True).returncode == 0


def test_unclosed_tags_are_linear():
    import time

    start = time.perf_counter()
    assert len(page_words("<i>x</b>" * 20000)[0]) == 20000
    assert time.perf_counter() - start < 3


def test_result_formats(spark):
    rows = spark.createDataFrame([(0.2, 1.006), (0.999, 12.3456), (1.0, 0.0), (12.5, 3.999)], "ms double, score double").select(format.shown_time("ms").alias("t"), format.shown_score("score").alias("s"))
    assert [tuple(r) for r in rows.collect()] == [("< 1", "1.01"), ("< 1", "12.35"), ("1", "0.00"), ("13", "4.00")]


def test_shown_time_takes_halves_to_even(spark):
    rows = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (3.5,), (2.51,)], "ms double")
    assert [x[0] for x in rows.select(shown_time("ms", even=True)).collect()] == ["< 1", "2", "2", "4", "3"]


def test_a_name_without_a_semicolon_is_text():
    assert page_words("<title>the&amp;&amp</title><b>x&eacute;y &copy z&ampq")[0] == ["the", "amp", "x", "y", "copy", "z", "ampq"]
    assert page_words("<title>a&amp</title>")[1] == ["a", "amp"]


def test_stems_of_lists_hold_no_words():
    """A batch of many words: a worker keeps distinct words as Python strings, not each word."""
    lists = pa.array([None, [], ["running", None, "dogs"], *[["running", "dogs", "the", "flies"] * 1000] * 500])[1:]
    tracemalloc.start()
    got = stem.porter_stem_all.func(lists)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.slice(0, 3).to_pylist() == [[], ["run", None, "dog"], ["run", "dog", "the", "fli"] * 1000] and peak < 1 << 20
    assert stem.porter_stem_all.func(pa.array([None, ["cats"]])).to_pylist() == [None, ["cat"]]
