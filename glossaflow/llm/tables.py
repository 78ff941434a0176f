"""Intermediate tables in the shared folder, removed when no longer needed."""

from __future__ import annotations

import atexit
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

from glossaflow.sources.scratch import scratch_path

# While a table is written: shuffle files of a finished write are of no more use, and
# texts go to Python in batches of bounded bytes, which both sides hold more than once.
_WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    # Tables cut by a column of few values are written without a sort by it.
    "spark.sql.maxConcurrentOutputFileWriters": "8",
}
_held: set[str] = set()


def keep(df: DataFrame, label: str, *partition_by: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and its path.

    Cuts the lineage: a lost executor costs no second computation. What
    :func:`drop` has not removed goes when the application ends.
    """
    path = scratch_path(df.sparkSession, label)
    _held.add(path)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    spark = df.sparkSession
    with writing(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """Settings for a job of an operator's own; the session's come back afterwards."""
    before = {name: spark.conf.get(name, None) for name in _WHILE_WRITING}
    for name, value in _WHILE_WRITING.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables made by :func:`keep`."""
    _delete(spark.sparkContext, paths)


def _delete(context: SparkContext, paths) -> None:
    for path in list(paths):
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
        _held.discard(path)


@atexit.register
def _delete_rest() -> None:
    context = SparkContext._active_spark_context
    if context is not None and context._jsc is not None:
        _delete(context, _held)
