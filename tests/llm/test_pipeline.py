"""The corpus pipeline: each stage against a brute-force version, and the whole."""

from __future__ import annotations

import base64
import random
from collections import Counter
from itertools import combinations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusrank.llm import langid, packing, pii

from .test_operators import WORDS, brute_classes, check_packing, documents, jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stage_names():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "redact_pii", "pack"]
    assert corpus_pipeline.ORACLE_SQL is None


FOREIGN = [  # no language of the tables
    "Это совершенно обычное русское предложение о кошках и собаках",
    "Bu tamamen sıradan bir Türkçe cümledir ve herkes tarafından yazılabilirdi, köpekler ve kediler hakkında",
    base64.b64encode(bytes(range(256))).decode(),
    "for (int i = 0; i < n; i++) { if (x[i] > 0) return foo(x[i], y); } // done\n" * 4,
    "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz", k=300)),
]


def test_language_stage(spark, data):
    data = data.replace("sf0.001", "sf0.01")  # enough documents to learn what code lengths are usual
    docs = spark.read.parquet(f"{data}/documents.parquet")
    junk = [(9100 + i, t, None, None, len(t)) for i, t in enumerate(FOREIGN)]
    more = docs.unionByName(spark.createDataFrame([(9001, None, None, None, 0), (9002, "12345 !!", None, None, 8), (9003, "鬱" * 50, None, None, 50), (9004, "THE AND OF THE 12345 WAS", None, None, 24), *junk], SCHEMA))
    rows = corpus_pipeline.language_id(spark, more, data)
    assert rows.columns == docs.columns
    got = {r["doc_id"]: r["lang"] for r in rows.collect()}
    assert set(got) == {r[0] for r in documents(data)} | {9004}
    assert got[9004] == "en" and sum(got[i] == lang for i, _, lang in documents(data)) >= 0.995 * docs.count()
    model = langid.train(more)
    assert all(got[r["doc_id"]] == langid.predict_texts(model, [r["text"]])[0][0] for r in more.collect() if r["doc_id"] in got)
    none = docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang", "source", "n_chars")
    assert corpus_pipeline.language_id(spark, none, data).count() == docs.count()


CLASH = {"lang_pred": "p", "bits_per_byte": "b", "score": "s", "redacted": "r", "base": "x", "spans": "y", "row": "w", "__row": "v", "kept": "k", "component": "c", "a.b": "d", "q`r": "e"}


def test_stages_keep_clashing_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 60")
    more = docs.select("*", *[F.concat(F.lit(v), F.col("doc_id")).alias(k) for k, v in CLASH.items()])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, more, data)
        assert got.columns == more.columns, name
        rows = got.collect()
        assert rows and all(r[k] == f"{v}{r['doc_id']}" for r in rows for k, v in CLASH.items()), name
        plain = {r["doc_id"]: r for r in stage(spark, docs, data).collect()}
        assert {r["doc_id"]: tuple(r)[:5] for r in rows} == {k: tuple(r) for k, r in plain.items()}, name
    assert corpus_pipeline.pack(spark, more, data).count() == corpus_pipeline.pack(spark, docs, data).count()


def test_dedup_stage(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = documents(data)
    roots = brute_classes(len(rows), lambda i, j: rows[i][1] == rows[j][1] or jaccard(rows[i][1], rows[j][1]) >= 0.8)
    got = corpus_pipeline.near_dedup(spark, docs, data)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == {rows[c][0] for c in set(roots)}


def test_dedup_stage_finds_every_pair_of_more_documents(spark, data):
    data = data.replace("sf0.001", "sf0.01")
    rows = documents(data)
    words = [t.lower().split() for _, t, _ in rows]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    common = Counter(p for own in holders.values() for p in combinations(own, 2))
    near = {(i, j) for (i, j), n in common.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)}
    roots = brute_classes(len(rows), lambda i, j: (j, i) in near)
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{data}/documents.parquet"), data).collect()}
    assert len(near) > 100 and got == {rows[c][0] for c in set(roots)}


def test_dedup_stage_when_scans_are_split_anew(spark, data, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").repartition(12)
    docs.write.parquet(str(tmp_path / "documents"))
    docs, near = spark.read.parquet(str(tmp_path / "documents")), corpus_pipeline.simhash.near_duplicates

    def then_split(*args, **kwargs):
        found = corpus_pipeline.checkpoint(near(*args, **kwargs))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")  # as when executors come or go
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        return found

    spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
    try:
        want = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, data).collect()}
        monkeypatch.setattr(corpus_pipeline.simhash, "near_duplicates", then_split)
        got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, data).collect()]
    finally:
        for name in ("openCostInBytes", "minPartitionNum", "maxPartitionBytes"):
            spark.conf.unset(f"spark.sql.files.{name}")
    assert set(got) == want and len(got) == len(want) < docs.count()


def test_dedup_stage_edges(spark, data):
    rows = [(None, "same words in this one text", None, None, None), (5, "same words in this one text", None, None, None), (5, "same words in this one text", None, None, None), (6, None, None, None, None), (7, "", None, None, None)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), data).collect()
    assert sorted(r["doc_id"] for r in got) == [5, 6]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), data).count() == 0


def test_redaction_stage(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.redact_pii(spark, docs, data).collect()}
    model = pii.train()
    for i, t, lang in documents(data):
        text = pii.redact(t, pii.all_spans(t, model)[1])
        assert (got[i]["text"], got[i]["n_chars"], got[i]["lang"]) == (text, len(text), lang)
        assert not pii.base_spans(got[i]["text"])


def test_whole_pipeline(spark, data):
    got = corpus_pipeline.run(spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
    left = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    keys = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, got.select(*keys).collect())) == sorted((r["row"], r["start"], r["length"], r["crc"], r["tokens"]) for r in left.collect())
    renamed = got.withColumnsRenamed({"doc_id": "row", "ids_crc32": "crc", "doc_tokens": "tokens"}).collect()
    check_packing(renamed, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert WORDS and pytest
