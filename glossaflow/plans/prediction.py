"""Batch prediction jobs around a user's function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaflow import patterns as P
from glossaflow.functions import records as R
from glossaflow.functions import text as X
from glossaflow.operators.predict import batch_predict
from glossaflow.operators.rows import head_n


def predict_chats(
    chats: DataFrame,
    make_predictor: Callable[[], Callable],
    system: str,
    instruction: str,
    limit: int | None = None,
) -> DataFrame:
    """Prediction rows of chat records ``(row_idx, messages, audios)``.

    The function gets the structured prompt. Its answer is cleaned of decoding
    leftovers, and of a two-line answer only the translation is kept.
    """
    part = chats if limit is None else head_n(chats, limit)
    audio = R.first_media(F.col("audios"))
    rows = part.select(
        F.col("row_idx").alias("id"),
        audio.alias("audio"),
        R.last_content(F.col("messages")).alias("reference"),
        R.prompt(system, instruction, audio).alias("_prompt"),
    )
    out = batch_predict(rows, F.col("_prompt"), make_predictor)
    answer = X.labelled_line(X.clean_prediction(F.col("prediction")))
    return out.select(
        "id", "audio", "reference", answer.alias("prediction"), "status", "latency_s"
    )


def predict_texts(
    asr: DataFrame,
    make_predictor: Callable[[], Callable],
    system: str,
    prefix: str,
    *keep: str,
) -> DataFrame:
    """Text prediction rows of ASR rows ``(row_idx, idx, pred_zh, ref_zh)``.

    Rows with a blank side stay, with an error and without a function call. The
    columns in ``keep`` (such as the shard) are carried along.
    """
    src, ref = F.col("pred_zh"), F.col("ref_zh")
    rows = asr.select(
        *keep,
        F.coalesce("idx", "row_idx").alias("idx"),
        X.normalize_text(X.or_empty(src)).alias("src_en"),
        X.normalize_text(X.or_empty(ref)).alias("ref_zh"),
        (~X.is_blank(src) & ~X.is_blank(ref)).alias("_filled"),
    )
    prompt = R.prompt(system, F.concat(F.lit(prefix), F.col("src_en")))
    rows = rows.withColumn("_prompt", F.when(F.col("_filled"), prompt))
    out = batch_predict(rows, F.col("_prompt"), make_predictor)
    ok = F.col("status") == P.STATUS_OK
    error = (
        F.when(~F.col("_filled"), P.EMPTY_ERROR)
        .when(~ok, F.regexp_replace("status", r"\A" + P.STATUS_ERROR, ""))
    )
    return out.select(
        *keep, "idx", "src_en", "ref_zh",
        X.strip_ws(X.or_empty(F.col("prediction"))).alias("pred_zh"),
        F.when(ok, F.col("latency_s")).alias("latency_sec"),
        error.alias("error"),
    )
