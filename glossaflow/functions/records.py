"""Chat records as arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossaflow import patterns as P


def _turn(role: str, content: str | Column) -> Column:
    body = content if isinstance(content, Column) else F.lit(content)
    return F.struct(F.lit(role).alias("role"), body.alias("content"))


def messages(system: str, user: str | Column, assistant: Column) -> Column:
    """The three turns of a training record."""
    return F.array(
        _turn("system", system), _turn("user", user), _turn("assistant", assistant)
    )


def speech_messages(system: str, instruction: str, target: Column) -> Column:
    """Record whose user turn is a media mark and an instruction."""
    return messages(system, P.MEDIA_MARK + instruction, target)


def text_messages(system: str, prefix: str, source: Column, target: Column) -> Column:
    """Record whose user turn is a prefix and the source text."""
    return messages(system, F.concat(F.lit(prefix), source), target)


def two_step_answer(transcription: Column, translation: Column) -> Column:
    """Two labelled lines, built from the fields as they are."""
    return F.concat(
        F.lit(P.TRANSCRIPTION_LABEL), transcription,
        F.lit("\n" + P.TRANSLATION_LABEL), translation,
    )


def last_content(msgs: Column, role: str = "assistant") -> Column:
    """Content of the last turn of ``role``; null when there is none."""
    turns = F.filter(msgs, lambda m: m["role"] == F.lit(role))
    return F.try_element_at(turns, F.lit(-1))["content"]


def first_media(paths: Column) -> Column:
    """First media path of a record; null when there is none."""
    return F.get(paths, F.lit(0))


def _part(kind: str, text: Column | None, audio: Column | None) -> Column:
    empty = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("type"),
        (empty if text is None else text).alias("text"),
        (empty if audio is None else audio).alias("audio"),
    )


def prompt(system: str, text: str | Column, audio: Column | None = None) -> Column:
    """Structured prompt: a system turn and a user turn made of content parts."""
    body = text if isinstance(text, Column) else F.lit(text)
    parts = [] if audio is None else [_part("audio", None, audio)]
    parts.append(_part("text", body, None))
    return F.array(
        F.struct(
            F.lit("system").alias("role"),
            F.array(_part("text", F.lit(system), None)).alias("content"),
        ),
        F.struct(F.lit("user").alias("role"), F.array(*parts).alias("content")),
    )
