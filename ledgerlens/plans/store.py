"""Tables that several queries of one session read, written once.

A stored table is made by its ``build`` function when a session first asks for
it with these inputs, and read back afterwards. It lies in the folder that
``spark.checkpoint.dir`` names, so every executor reads it and a lost executor
costs nothing. The key holds each input's size, number of files and time of
change, so new data under the same path make a new table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

_MADE: dict[tuple, Any] = {}


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """(path, bytes, files, time of change) by the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    summary = fs.getContentSummary(at)
    return path, summary.getLength(), summary.getFileCount(), fs.getFileStatus(at).getModificationTime()


def once(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], Any]) -> Any:
    """What ``build`` makes of the files or folders ``inputs``, made when this
    session first asks for it."""
    key = (spark.sparkContext.applicationId, name, *(fingerprint(spark, p) for p in inputs))
    if key not in _MADE:
        _MADE[key] = build()
    return _MADE[key]


def stored(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` made from ``inputs``, written once a session."""
    def write() -> str:
        path = f"{ensure_checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
        build().write.parquet(path)
        return path
    return spark.read.parquet(once(spark, name, inputs, write))


def bucketed(spark: SparkSession, name: str, inputs: list[str], key: str, buckets: int,
             build: Callable[[], DataFrame]) -> DataFrame:
    """``stored`` as a table bucketed and sorted by ``key``: what groups or orders
    by it reads the buckets without a shuffle. ``build`` gives rows that lie in
    as many hash partitions by the key, so each bucket is one file."""
    def write() -> str:
        table = f"{name}_{uuid.uuid4().hex}"
        build().write.format("parquet").option("path", f"{ensure_checkpoint_dir(spark)}/tables/{table}") \
            .bucketBy(buckets, key).sortBy(key).saveAsTable(table)
        return table
    return spark.table(once(spark, name, inputs, write))
