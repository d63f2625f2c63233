"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_state = threading.local()


def root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode, a folder of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="vaultspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remember(path: str, table: str | None, outlives: int) -> None:
    """Note a table with the innermost scope, or with one around it."""
    scopes = getattr(_state, "scopes", [])
    at = len(scopes) - 1 - outlives
    if at >= 0:
        scopes[at].append((path, table))


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at its end, but for those that outlive it; what Spark holds for them may go as well."""
    if not hasattr(_state, "scopes"):
        _state.scopes = []
    _state.scopes.append([])
    try:
        yield
    finally:
        for path, table in _state.scopes.pop():
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
        swept(spark)


def swept(spark: SparkSession) -> None:
    """Let Spark drop the broadcasts and shuffle files of plans that nothing refers to any more: it does so when the driver's JVM collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def rested(spark: SparkSession) -> None:
    """Let the executors' JVMs collect their garbage: it holds buffers outside the heap, and pages of the heap that workers beside it could use, until a full collection, which a large heap puts off."""
    tasks = spark.sparkContext.defaultParallelism  # one for each core, so that every executor gets some
    spark.range(0, tasks, 1, tasks).selectExpr("java_method('java.lang.System', 'gc') AS done").collect()


def written(df: DataFrame, name: str, outlives: int = 0) -> DataFrame:
    """``df`` as a table: later reads neither repeat its work nor depend on the executors that did it. It outlives so many scopes."""
    path = f"{root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _remember(path, None, outlives)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """``df`` as a table in buckets of ``key``: joins on ``key`` don't move its rows again. Deal ``df`` by ``key`` first, or each task writes a file for each bucket."""
    spark, own = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{root(spark)}/{own}"
    _remember(path, own, 0)
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(own)
    return spark.table(own)
