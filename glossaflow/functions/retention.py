"""How many of a row's entities its prediction holds, in one pass over the prediction.

An automaton of a row's entities (Aho and Corasick) is built in time linear in their
letters and reads the prediction once, however many entities there are; searching for
one entity after the other reads it once for each. Work stays with the row: an array
and a text go in, one number comes out.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def count_found(entities: list[str], text: str) -> int:
    """How many distinct ``entities`` occur in ``text`` as substrings."""
    automaton = ahocorasick.Automaton()
    for entity in entities:
        if entity:
            automaton.add_word(entity, entity)
    wanted = len(automaton)
    if not wanted or not text:
        return 0
    automaton.make_automaton()
    seen: set[str] = set()
    for _, entity in automaton.iter(text):
        seen.add(entity)
        if len(seen) == wanted:
            break
    return len(seen)


def retained(found: Column, prediction: Column) -> Column:
    """How many of ``found`` (distinct, none empty) occur in ``prediction`` as substrings.

    Null entities give null; a null prediction holds none.
    """
    def count(entities: pa.Array, texts: pa.Array) -> pa.Array:
        rows = (
            None if not e.is_valid else count_found(e.as_py(), t.as_py() or "")
            for e, t in zip(entities, texts)
        )
        return pa.array(list(rows), pa.int64())

    count.__annotations__ = {"entities": pa.Array, "texts": pa.Array, "return": pa.Array}
    # As in pair_stats: a filter on the count is not pushed below it.
    return F.arrow_udf(count, returnType="bigint").asNondeterministic()(found, prediction)
