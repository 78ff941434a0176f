"""Feature cache jobs: fill what is missing, audit what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaflow.operators import cache as C
from glossaflow.operators.predict import batch_predict


def extract_pending(
    items: DataFrame,
    cache: DataFrame,
    make_extractor: Callable[[], Callable],
    returns: str = "array<array<float>>",
) -> DataFrame:
    """Features of items ``(row_idx, audio_path)`` whose path is not cached yet.

    The function gets the path. A path it fails on is a row with its status and
    null features; count outcomes with ``status_counts`` and keep the ``ok``
    rows. A path several items share is worked on once, for its last position.
    """
    todo = C.path_index(C.pending_items(items, cache))
    out = batch_predict(todo, F.col("audio_path"), make_extractor, returns)
    return out.select("audio_path", "idx", F.col("prediction").alias("features"), "status")


def audit(
    items: DataFrame,
    indexes: list[tuple[str, DataFrame]],
    features: DataFrame,
    *by: str,
) -> DataFrame:
    """Look items up in the merged index of all splits and count what alignment does.

    ``items`` holds ``audio_path`` and ``expected_len``; ``features`` one row
    ``(split, idx, features)`` per cached entry. An entry without features
    counts as a miss. Frames are counted where they are read, so only lengths
    are shuffled.
    """
    lengths = features.select("split", "idx", F.size("features").alias("have"))
    cached = C.merge_index(indexes).join(lengths, ["split", "idx"])
    return C.cache_audit(C.cache_lookup(items, cached), *by)


def cached_batches(
    items: DataFrame,
    indexes: list[tuple[str, DataFrame]],
    features: DataFrame,
    batch_size: int,
) -> DataFrame:
    """Cached, aligned frames of each run of ``batch_size`` items, in item order.

    Items are ``(row_idx, audio_path, expected_len)``. The first item without
    cached features stops the job, whether the index or the frames lack it. The
    index is joined before the frames, so frames are shuffled once.
    """
    found = C.cache_lookup(items, C.merge_index(indexes), strict=True).filter("hit")
    frames = F.when(F.col("features").isNotNull(), F.col("features")).otherwise(
        F.raise_error(F.concat(F.lit("no cached features for "), F.col("audio_path")))
    )
    rows = found.join(features, ["split", "idx"], "left").withColumn("features", frames)
    return C.batch_concat(C.with_aligned(rows), batch_size)
