"""Training-record jobs. Prompt texts are the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaflow.functions import records as R
from glossaflow.functions import text as X
from glossaflow.operators import rows as O


def speech_records(
    corpus: DataFrame, folder: str, system: str, instruction: str
) -> DataFrame:
    """Speech records of corpus rows ``(row_idx, translation)``.

    Rows with a blank target are left out; the others keep the media path of
    their corpus position, so paths may have gaps.
    """
    target = X.normalize_text(F.col("translation"))
    return O.drop_blank(corpus, "translation").select(
        "row_idx",
        R.speech_messages(system, instruction, target).alias("messages"),
        F.array(X.media_path(folder, F.col("row_idx"))).alias("audios"),
    )


def test_records(
    corpus: DataFrame, size: int, folder: str, system: str, instruction: str
) -> DataFrame:
    """Speech records of exactly the first ``size`` corpus rows, which must exist."""
    return speech_records(O.head_n(corpus, size, strict=True), folder, system, instruction)


def text_records(
    asr: DataFrame, system: str, prefix: str, limit: int | None = None
) -> DataFrame:
    """Text records of ASR rows ``(row_idx, pred_zh, ref_zh)`` with both sides filled.

    ``limit`` keeps the first records in source order.
    """
    sides = ("pred_zh", "ref_zh")
    if limit is None:
        kept = O.drop_blank(asr, *sides)
    else:
        kept = O.first_n_valid(asr, limit, *sides)
    msgs = R.text_messages(system, prefix, *[X.normalize_text(F.col(c)) for c in sides])
    return kept.select("row_idx", msgs.alias("messages"))


def two_step_records(
    records: DataFrame,
    corpus: DataFrame,
    system: str,
    instruction: str,
    offset: int = 0,
    n: int | None = None,
    by_key: bool = False,
) -> DataFrame:
    """Records whose answer is transcription and translation on two lines.

    The fields come from the corpus row at the record's position, or with
    ``by_key`` from the row its media path names. Both fields are used as they are.
    """
    part = records if n is None else O.slice_n(records, offset, n)
    part = part.select("row_idx", "audios")
    if by_key:
        path = R.first_media(F.col("audios"))
        joined = O.keyed_join(part, corpus, path, "sentence", "translation")
    else:
        joined = O.positional_join(part, corpus, "sentence", "translation")
    answer = R.two_step_answer(F.col("sentence"), F.col("translation"))
    return joined.select(
        "row_idx",
        R.speech_messages(system, instruction, answer).alias("messages"),
        "audios",
    )


def target_mismatches(records: DataFrame, corpus: DataFrame) -> DataFrame:
    """Records whose last assistant turn differs from the corpus row at their position."""
    joined = O.positional_join(records, corpus, "translation")
    own = R.last_content(F.col("messages"))
    return O.alignment_check(joined, own, F.col("translation"))
