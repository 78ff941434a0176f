"""Functions on feature sequences (arrays of frames)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def align_length(frames: Column, expected: Column) -> Column:
    """Bring a sequence to ``expected`` frames.

    Shorter ones repeat their last frame, longer ones are cut. An empty
    sequence has nothing to repeat and stays empty.
    """
    have = F.size(frames)
    want = expected.cast("int")
    padded = F.concat(
        frames, F.array_repeat(F.element_at(frames, -1), want - have)
    )
    return (
        F.when((have == 0) | (have == want), frames)
        .when(have < want, padded)
        .otherwise(F.slice(frames, F.lit(1), want))
    )


def adjustment(have: Column, want: Column) -> Column:
    """What :func:`align_length` does to ``have`` frames: a word, null for null."""
    return (
        F.when(have.isNull() | want.isNull(), F.lit(None).cast("string"))
        .when(have == 0, "empty").when(have < want, "padded")
        .when(have > want, "cut").otherwise("exact")
    )


def aligned_length(have: Column, want: Column) -> Column:
    """How many frames :func:`align_length` leaves of ``have``."""
    return F.when(have == 0, F.lit(0)).otherwise(want)


def strip_padding(frames: Column, mask: Column) -> Column:
    """Keep the frames whose mask entry is true."""
    return F.filter(frames, lambda x, i: F.coalesce(F.get(mask, i), F.lit(False)))


def valid_length(mask: Column) -> Column:
    """Number of true mask entries."""
    return F.size(F.filter(mask, lambda m: m))
