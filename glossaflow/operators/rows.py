"""Filters, slices, joins by position or key, and merges of row sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaflow import patterns as P
from glossaflow.functions import text as X



# -- filters ------------------------------------------------------------------

def drop_blank(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which every named text holds more than white space.

    Test the texts as they come, before normalising: looking for one visible
    character is cheap, while a filter on a normalised column makes Spark
    normalise twice, once below the filter and once above it.
    """
    return df.filter(
        reduce(lambda a, b: a & b, [~X.is_blank(F.col(c)) for c in columns])
    )


def is_valid() -> Column:
    """True for rows that ended well and hold a non-blank prediction."""
    return F.col("status").eqNullSafe(P.STATUS_OK) & ~X.is_blank(F.col("prediction"))


def valid_predictions(df: DataFrame) -> DataFrame:
    """The valid rows, their texts untouched."""
    return df.filter(is_valid())


def is_filled(prediction: Sequence[str], reference: Sequence[str]) -> Column:
    """True for rows whose first present candidate of both sides holds text."""
    first = [F.coalesce(*[F.col(c) for c in side]) for side in (prediction, reference)]
    return ~X.is_blank(first[0]) & ~X.is_blank(first[1])


def coalesced_pairs(
    df: DataFrame, prediction: Sequence[str], reference: Sequence[str]
) -> DataFrame:
    """Add ``pred`` and ``ref`` from candidate columns and keep filled pairs."""
    pred = [F.col(c) for c in prediction]
    ref = [F.col(c) for c in reference]
    kept = [c for c in df.columns if c not in ("pred", "ref")]
    return df.filter(is_filled(prediction, reference)).select(
        *kept, X.coalesce_fields(*pred).alias("pred"), X.coalesce_fields(*ref).alias("ref")
    )


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """``df``, or an error when it has no row at all (runs one small job)."""
    if df.isEmpty():
        raise ValueError(message)
    return df


# -- prefixes and slices ------------------------------------------------------

def first_n_valid(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """The first ``n`` rows, in source order, whose named texts are filled.

    A job over positions alone finds where the ``n``-th such row stands; the rows
    themselves are then filtered where they are and meet in no one task.
    """
    valid = drop_blank(df, *columns)
    last = valid.select("row_idx").orderBy("row_idx").limit(n).agg(F.max("row_idx")).first()[0]
    kept = valid.filter(F.col("row_idx") <= last if last is not None else F.lit(False))
    return kept.orderBy("row_idx")


def head_n(df: DataFrame, n: int, strict: bool = False) -> DataFrame:
    """Rows at positions below ``n``; ``strict`` demands that all ``n`` exist."""
    if strict and n > 0 and df.filter(F.col("row_idx") == n - 1).isEmpty():
        raise ValueError(f"source has fewer than {n} rows")
    return df.filter(F.col("row_idx") < n)


def slice_n(df: DataFrame, offset: int, n: int) -> DataFrame:
    """Rows at positions ``offset`` up to ``offset + n``, as far as they exist."""
    return df.filter((F.col("row_idx") >= offset) & (F.col("row_idx") < offset + n))


# -- joins --------------------------------------------------------------------

def positional_join(records: DataFrame, corpus: DataFrame, *columns: str) -> DataFrame:
    """Give each record the named corpus columns at the record's own position.

    A corpus that is too short stops the job. Positions are unique on both
    sides, so neither side can be skewed.
    """
    side = corpus.select(F.col("row_idx"), F.struct(*columns).alias("_c"))
    found = F.when(F.col("_c").isNotNull(), F.col("_c")).otherwise(
        F.raise_error(F.format_string("corpus has no row %d", F.col("row_idx")))
    )
    joined = records.join(side, "row_idx", "left").withColumn("_c", found)
    return joined.select(*records.columns, "_c.*")


def keyed_join(
    records: DataFrame, corpus: DataFrame, path: Column, *columns: str
) -> DataFrame:
    """As :func:`positional_join`, by the ordinal in the record's media path.

    The ordinal survives skipped rows, so records cannot drift against the corpus.
    A record without an ordinal or without a corpus row stops the job.
    """
    side = corpus.select(F.col("row_idx").alias("_ord"), F.struct(*columns).alias("_c"))
    found = F.when(F.col("_c").isNotNull(), F.col("_c")).otherwise(
        F.raise_error(F.concat(F.lit("no corpus row for media "), F.coalesce(path, F.lit("null"))))
    )
    keyed = records.withColumn("_ord", X.media_ordinal(path))
    joined = keyed.join(side, "_ord", "left").withColumn("_c", found)
    return joined.select(*records.columns, "_c.*")


def alignment_check(joined: DataFrame, own: Column, other: Column, width: int = 60) -> DataFrame:
    """Joined rows whose two normalised targets differ, with short previews."""
    a, b = X.normalize_text(own), X.normalize_text(other)
    return joined.filter(~a.eqNullSafe(b)).select(
        "row_idx",
        X.preview(own, width).alias("record_preview"),
        X.preview(other, width).alias("corpus_preview"),
    )


# -- merges -------------------------------------------------------------------

def merge_chunks(chunks: Sequence[DataFrame]) -> DataFrame:
    """All rows of chunks whose field names differ; absent fields become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), chunks)


def assemble_chats(turns: DataFrame, key: str = "conv_id", part_turns: int | None = None) -> DataFrame:
    """``messages`` arrays from one-turn rows ``(key, turn, role, text)``.

    One record per conversation. With ``part_turns`` every so many turns (numbered
    from 0) make one record, told apart by ``part``, for conversations too long for
    one row.
    """
    part = F.floor(F.col("turn") / part_turns if part_turns else F.lit(0)).alias("part")
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    grouped = turns.select(key, part, turn.alias("_t")).groupBy(key, "part").agg(
        F.array_sort(F.collect_list("_t")).alias("_ts")
    )
    bare = F.transform(
        "_ts", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))
    )
    parts = ["part"] if part_turns else []
    return grouped.select(key, *parts, bare.alias("messages"))


def last_turn(turns: DataFrame, role: str, key: str = "conv_id") -> DataFrame:
    """Last text of ``role`` per conversation, null where it never speaks.

    ``max_by`` combines before the shuffle, whatever a conversation's length.
    """
    own = F.when(F.col("role") == role, F.col("turn"))
    return turns.groupBy(key).agg(F.max_by("text", own).alias("content"))
