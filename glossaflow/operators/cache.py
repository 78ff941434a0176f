"""Feature cache: path index, look-up, incremental work list, audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaflow.functions.frames import adjustment, align_length, aligned_length


def path_index(items: DataFrame) -> DataFrame:
    """``(audio_path, idx)``; the last position wins for a repeated path."""
    return items.groupBy("audio_path").agg(F.max("row_idx").alias("idx"))


def merge_index(indexes: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """One index of several splits; the later split wins for a shared path."""
    if not indexes:
        raise ValueError("no index to merge")
    tagged = None
    for rank, (split, index) in enumerate(indexes):
        one = index.select(
            "audio_path", F.struct(F.lit(rank).alias("rank"), F.lit(split).alias("split"), "idx").alias("_v")
        )
        tagged = one if tagged is None else tagged.unionAll(one)
    return tagged.groupBy("audio_path").agg(F.max("_v").alias("_v")).select(
        "audio_path", "_v.split", "_v.idx"
    )


def pending_items(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Items whose path has no cached features yet."""
    return items.join(cache.select("audio_path"), "audio_path", "left_anti").select(
        *items.columns
    )


def cache_lookup(items: DataFrame, index: DataFrame, strict: bool = False) -> DataFrame:
    """Items with ``split`` and ``idx`` of their cached features and ``hit``.

    ``strict`` stops the job at the first miss. The index has one row per path,
    so a path shared by very many items is skewed on the items' side only, which
    adaptive execution splits.
    """
    found = items.join(index, "audio_path", "left")
    hit = F.col("idx").isNotNull()
    if strict:
        hit = F.when(hit, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("no cached features for "), F.col("audio_path")))
        )
    return found.withColumn("hit", hit)


def with_aligned(rows: DataFrame, frames: str = "features", expected: str = "expected_len") -> DataFrame:
    """Frames brought to the expected length, and what that took (``adjustment``)."""
    return rows.withColumns({
        "adjustment": adjustment(F.size(frames), F.col(expected)),
        frames: align_length(F.col(frames), F.col(expected)),
    })


def batch_concat(
    rows: DataFrame, batch_size: int, frames: str = "features", on_missing: str = "fail"
) -> DataFrame:
    """Frames of each run of ``batch_size`` positions, joined in position order.

    A batch holds ``batch_size`` rows at most, so groups stay bounded. A sample whose
    frames are null stops the job and is named by its position; with
    ``on_missing="report"`` it adds no frames, and ``missing`` counts such samples.
    """
    if on_missing not in ("fail", "report"):
        raise ValueError("on_missing is 'fail' or 'report'")
    report = on_missing == "report"
    batch = F.floor(F.col("row_idx") / batch_size).alias("batch")
    there = F.col(frames).isNotNull()
    known = F.col(frames) if report else F.when(there, F.col(frames)).otherwise(
        F.raise_error(F.format_string("no frames for the sample at position %d", F.col("row_idx")))
    )
    grouped = rows.select(batch, F.struct("row_idx", known.alias("f")).alias("_x"))
    ordered = F.array_sort(F.collect_list("_x"))
    return (
        grouped.groupBy("batch").agg(ordered.alias("_xs"))
        .select(
            "batch",
            F.size("_xs").cast("bigint").alias("samples"),
            *([F.size(F.filter("_xs", lambda x: x["f"].isNull())).cast("bigint").alias("missing")] if report else []),
            F.flatten(F.transform(F.filter("_xs", lambda x: x["f"].isNotNull()), lambda x: x["f"])).alias(frames),
        )
    )


def cache_audit(looked_up: DataFrame, *by: str) -> DataFrame:
    """Hits, misses, length adjustments and aligned frames of looked-up rows.

    ``looked_up`` holds ``hit``, the number ``have`` of cached frames, and
    ``expected_len``; the frames themselves are not needed.
    """
    have, want = F.col("have"), F.col("expected_len")

    def count(kind: str):
        return F.count_if(F.col("hit") & (adjustment(have, want) == kind)).alias(kind)

    return looked_up.groupBy(*by).agg(
        F.count("*").alias("items"),
        F.count_if("hit").alias("hits"),
        F.count_if(~F.col("hit")).alias("misses"),
        count("padded"), count("cut"), count("exact"), count("empty"),
        F.coalesce(
            F.sum(F.when(F.col("hit"), aligned_length(have, want).cast("bigint"))),
            F.lit(0),
        ).alias("frames"),
    )
