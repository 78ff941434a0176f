"""Bounded samples of labelled rows, whatever share of the rows one id has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_of(labels: DataFrame, column: str, usable, rows: int) -> DataFrame:
    """``doc_id`` and ``column`` of at most ``rows`` usable label rows, those of smallest id hash."""
    known = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & usable)
    picked = known.select("doc_id", F.col(column).cast("int").alias(column))
    return picked.orderBy(F.xxhash64("doc_id"), "doc_id", column).limit(rows)


def one_text_each(documents: DataFrame, sample: DataFrame) -> DataFrame:
    """``doc_id, text`` of the sample's ids: of rows that share an id, one text of smallest hash.

    Hashes decide first, copies then combine before the shuffle, so no task holds more
    texts than the sample has ids. Only the sample is broadcast, whose size is bounded.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_h"))
    ids = F.broadcast(sample.select("doc_id").distinct())
    least = rows.join(ids, "doc_id").groupBy("doc_id").agg(F.min("_h").alias("_h"))
    return rows.join(F.broadcast(least), ["doc_id", "_h"]).dropDuplicates(["doc_id"]).select("doc_id", "text")
