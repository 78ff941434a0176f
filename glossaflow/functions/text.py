"""Row-local text functions, all built from JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossaflow import patterns as P


def strip_ws(c: Column) -> Column:
    """Remove leading and trailing white space (full Unicode set).

    Looks at the outer characters first: most texts need no search at all.
    """
    outer = F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1)))
    bare = F.regexp_replace(
        F.regexp_replace(c, P.LEADING_WS, ""), P.TRAILING_WS, ""
    )
    return F.when(F.rlike(outer, F.lit(P.WS)), bare).otherwise(c)


def normalize_text(c: Column) -> Column:
    """Strip, and turn each run of white space into one space."""
    return F.trim(F.regexp_replace(c, P.WS_RUN, " "))


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return c.isNull() | ~F.rlike(c, F.lit(f"[^{P.WS[1:]}"))


def coalesce_fields(*candidates: Column) -> Column:
    """First non-null candidate, as stripped text; empty text if there is none.

    A blank first candidate wins over a filled second one.
    """
    return strip_ws(F.coalesce(*[c.cast("string") for c in candidates], F.lit("")))


def clean_prediction(c: Column) -> Column:
    """Strip, and drop decoding leftovers from the end until none remains."""
    ends = F.rlike(F.right(c, F.lit(1)), F.lit(P.TAIL_END))
    cut = F.when(ends, F.regexp_replace(c, P.TAIL, "")).otherwise(c)
    return F.regexp_replace(cut, P.LEADING_WS, "")


def labelled_line(c: Column, key: str = P.TRANSLATION_KEY) -> Column:
    """Text after the first line label ``key``; the stripped input without one."""
    lines = F.transform(F.split(c, P.LINE), strip_ws)
    hits = F.filter(lines, lambda s: F.startswith(F.lower(s), F.lit(key)))
    rest = F.substr(F.get(hits, F.lit(0)), F.lit(len(key) + 1))
    return F.coalesce(strip_ws(rest), strip_ws(c))


def tokenize_mixed(c: Column) -> Column:
    """Ideographs one by one, ASCII letter-digit runs as words."""
    return F.regexp_extract_all(c, F.lit(P.TOKEN), F.lit(0))


def capitalized_words(c: Column) -> Column:
    """Distinct words of ASCII letters that begin with a capital."""
    runs = F.regexp_extract_all(c, F.lit(P.WORD), F.lit(0))
    return F.array_distinct(
        F.filter(runs, lambda w: F.rlike(w, F.lit(P.CAPITALISED)))
    )


def numbers(c: Column) -> Column:
    """Distinct numbers, digits of any script."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(P.NUMBER), F.lit(0)))


def entities(c: Column) -> Column:
    """Distinct capitalised words and numbers."""
    return F.array_union(capitalized_words(c), numbers(c))


def media_path(folder: str | Column, ordinal: Column) -> Column:
    """Media file of a source row: the row's ordinal inside ``folder``."""
    base = folder if isinstance(folder, Column) else F.lit(folder)
    return F.concat(base, F.lit("/"), ordinal.cast("string"), F.lit(P.MEDIA_SUFFIX))


def media_ordinal(path: Column) -> Column:
    """Inverse of :func:`media_path`; null when the name holds no ordinal."""
    digits = F.regexp_extract(path, P.MEDIA_ORDINAL, 1)
    return F.when(digits != "", digits.cast("bigint"))


def path_name(c: Column) -> Column:
    """Last part of a path."""
    return F.regexp_extract(c, r"([^/]*)/*\z", 1)


def path_stem(c: Column) -> Column:
    """Last part of a path without its final suffix."""
    return F.regexp_replace(path_name(c), r"(?<=.)\.[^.]+\z", "")


def path_parent(c: Column) -> Column:
    """Everything before the last part of a path."""
    return F.regexp_extract(c, r"\A(.*?)/+[^/]*/*\z", 1)


def preview(c: Column, width: int) -> Column:
    """First ``width`` characters, for display columns only."""
    return F.left(c, F.lit(width))


def or_empty(c: Column) -> Column:
    """Optional text field: empty when absent."""
    return F.coalesce(c, F.lit(""))
