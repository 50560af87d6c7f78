"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where the master is local (tests), a local folder will do."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not named and master.partition("[")[0] != "local":
        raise RuntimeError(f"spark.checkpoint.dir is not set: on {master} what one executor writes to its own disk is lost to the others")
    if not named and app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="corpusrank-")
    return f"{(named or _local[app]).rstrip('/')}/corpusrank-{app}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Unlike a checkpoint of the plan, the result knows its true size, so that plans over many rounds neither inherit
    ever larger estimates nor miss a broadcast.  The order of rows and partitions is not kept.
    """
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if folder not in _left:
        _left.add(folder)
        atexit.register(_delete, spark, folder)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


_left: set[str] = set()


def release(df: DataFrame | None) -> None:
    """Delete what ``checkpoint`` wrote for ``df``; nothing that is still to be computed may read it."""
    path = getattr(df, "_written", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # at exit the session may be gone; the folder then stays with the shared one
        return


def pinned(df: DataFrame) -> DataFrame:
    """Spark's own checkpoint in the shared folder: rows stay in their partitions and in order."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint()
