"""Skip-what-is-cached as a stream: new record files are computed once.

The cache is a table in buckets, one folder per range of path hashes. A micro-batch
looks up its paths in the folders of its own buckets and lists and opens no files of others, so
its cost follows its paths and not the size of the cache.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glossaflow.operators.cache import pending_items
from glossaflow.sources.readers import named

# Folders of a new cache; a cache keeps the number it was begun with.
BUCKETS = 256


def bucket_of(path: Column, buckets: int = BUCKETS) -> Column:
    """Folder number of a path."""
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def cached_paths(spark: SparkSession, cache_path: str, buckets: Iterable[int]) -> DataFrame:
    """Paths cached in some buckets; the files of others are neither listed nor opened."""
    own = {f"bucket={b}" for b in buckets}
    folders = [f for f in named(spark, f"{cache_path}/bucket=*") if f.rpartition("/")[2] in own]
    if not folders:
        return spark.createDataFrame([], "audio_path STRING")
    return spark.read.schema("audio_path STRING").parquet(*folders)


def fill_cache(
    items: DataFrame,
    cache_path: str,
    compute: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Append features of streamed ``items`` whose path is not cached yet.

    ``compute`` turns pending items into cache rows, ``audio_path`` among them.
    A batch repeated after a failure finds its own rows cached and adds nothing
    twice; within one batch a path is computed once, for its last position where
    items carry ``row_idx``. Paths are dealt out by bucket before anything is
    computed, so every bucket of a batch is written by one task, as one file.
    """

    def step(batch: DataFrame, _: int) -> None:
        if "row_idx" in batch.columns:
            rest = [c for c in batch.columns if c != "audio_path"]
            last = F.max_by(F.struct(*rest), "row_idx").alias("_last")
            todo = batch.groupBy("audio_path").agg(last).select("audio_path", "_last.*").select(*batch.columns)
        else:
            todo = batch.dropDuplicates(["audio_path"])
        bucket = bucket_of(F.col("audio_path"), buckets)
        # At most ``buckets`` numbers.
        own = sorted(r[0] for r in batch.select(bucket).distinct().collect())
        todo = pending_items(todo, cached_paths(batch.sparkSession, cache_path, own)).repartition(bucket)
        rows = compute(todo).withColumn("bucket", bucket)
        rows.sortWithinPartitions("bucket").write.mode("append").partitionBy("bucket").parquet(cache_path)

    return (
        items.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
