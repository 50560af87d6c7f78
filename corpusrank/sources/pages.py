"""Readers: crawled pages as a tree of JSON files, Parquet tables, and query files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "url string, content string, _corrupt_record string"


def read_json_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, url, content) of every ``*.json`` file below ``root``, one object a file, in any letter case of the ending.

    A missing or null url becomes the file's path, a missing or null content the empty text.  Files that are not JSON
    objects are left out; ``rejected_pages`` lists them.
    """
    return with_defaults(_tree(spark, root).where("_corrupt_record IS NULL"))


def with_defaults(records: DataFrame) -> DataFrame:
    """(path, url, content) with the path for a missing url and the empty text for a missing content."""
    return records.select("path", F.coalesce("url", "path").alias("url"), F.coalesce("content", F.lit("")).alias("content"))


def rejected_pages(spark: SparkSession, root: str) -> DataFrame:
    """(path, record) of the files that ``read_json_tree`` leaves out."""
    return _tree(spark, root).where("_corrupt_record IS NOT NULL").select("path", F.col("_corrupt_record").alias("record"))


def _tree(spark: SparkSession, root: str) -> DataFrame:
    # read as whole text first: a query on nothing but the corrupt-record column is refused by the JSON reader
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[jJ][sS][oO][nN]").option("wholetext", True).text(root)
    return parsed_records(files.select(F.col("_metadata.file_path").alias("path"), "value"))


def parsed_records(files: DataFrame) -> DataFrame:
    """(path, url, content, _corrupt_record) of (path, value), a JSON object each; what is none has only the last."""
    parsed = F.from_json("value", PAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return files.select("path", "value", parsed.alias("p")).select("path", "p.url", "p.content", F.when(F.col("p").isNull(), F.col("value")).otherwise(F.col("p._corrupt_record")).alias("_corrupt_record"))


def pages_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table pages as (ord, url, content), in ingest order."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("ord"), "url", F.coalesce("html", F.lit("")).alias("content"))


def documents_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table documents as plain-text pages (ord, url, content); a document's URL is made from its source and id."""
    url = F.concat(F.lit("http://"), F.col("source"), F.lit(".example.org/doc/"), F.col("doc_id"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("ord"), url.alias("url"), F.coalesce("text", F.lit("")).alias("content"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query) from a text file with a query a line; blank lines are dropped, ids rise with the lines."""
    return query_lines(spark.read.option("wholetext", True).text(path)).select("query_id", "query")


def query_lines(files: DataFrame, *keep: str) -> DataFrame:
    """(keep, query_id, query): the trimmed lines of ``value`` that are not blank; ids are the places of the lines."""
    lines = files.select(*keep, F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("query_id", "query"))
    return lines.select(*keep, "query_id", F.regexp_replace("query", r"^\s+|\s+$", "").alias("query")).where("query <> ''")
