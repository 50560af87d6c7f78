"""Incremental ingest with Structured Streaming: new JSON pages are appended to a page table without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.urls import defragment
from ..operators.dedup import content_hash

PAGE = T.StructType([T.StructField("url", T.StringType()), T.StructField("content", T.StringType())])


def page_stream(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    """(path, url, content) of JSON pages as they appear below ``root``; unreadable files give no row."""
    lines = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[jJ][sS][oO][nN]").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).text(root)
    parsed = lines.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", PAGE).alias("p")).where("p IS NOT NULL")
    return parsed.select("path", F.coalesce("p.url", "path").alias("url"), F.coalesce("p.content", F.lit("")).alias("content"))


def ingest(spark: SparkSession, root: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append pages with contents not seen before to the Parquet table ``target``, and stop when the input is read.

    Each batch is cut to the first page (by path) of each content, and to contents that the table does not hold; the
    stream itself keeps no state.  A batch has a folder of its own in the table, ``batch=<number>``, and leaves out what
    an earlier try of it wrote, so that a batch that is run again after a failure replaces its rows.
    """
    pages = page_stream(spark, root).withColumn("content_md5", content_hash("content")).withColumn("url", defragment("url"))

    def append(batch: DataFrame, number: int) -> None:
        first = batch.groupBy("content_md5").agg(F.min("path").alias("path"))
        fresh = batch.join(first, ["content_md5", "path"], "left_semi")
        held = _held(spark, target, number)
        if held is not None:
            fresh = fresh.join(held, "content_md5", "left_anti")
        fresh.select("path", "url", "content", "content_md5").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return pages.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _held(spark: SparkSession, target: str, number: int) -> DataFrame | None:
    """The contents of the batches before, null if there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    if not any(int(n.removeprefix("batch=")) < number for n in names if n.startswith("batch=")):
        return None
    schema = "path string, url string, content string, content_md5 string, batch long"
    return spark.read.schema(schema).parquet(target).where(F.col("batch") < number).select("content_md5")
