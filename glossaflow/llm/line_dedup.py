"""Line dedup: an exact set-similarity join of lines; later matches are removed.

A line (``\\n``-separated) is the set of its distinct words, A-Z folded. Lines are
ordered by ``(doc_id, line number)``. A line goes if an earlier line has a Jaccard
similarity of 0.8 or more to it, whether or not that line stays itself. Lines of
equal sets form one class, whose later members go; a class's first line goes if an
earlier class is similar. Similar classes are found by prefix filtering
(:mod:`glossaflow.llm.prefix_join`).

Defined results: lines without a word stay; null text stays null; a text that loses
every line becomes empty; rows without ``doc_id`` stay as they are; rows that repeat
an id share its place in the order, so neither counts as earlier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from glossaflow.llm import prefix_join as J
from glossaflow.llm.tables import drop, keep
from glossaflow.llm.words import blocks, split

PERCENT = 80
# Lines of one word that are compared all with all.
COLD = 1_024


def line_sets(texts: pa.Array) -> Iterator[J.Sets]:
    """One set per line that has a word."""
    for row, data, offsets in blocks(texts):
        words = split(data, offsets, lower=True)
        breaks = np.flatnonzero(data == 10)
        owner = words.owner
        line = np.searchsorted(breaks, words.starts) - np.searchsorted(breaks, offsets[:-1])[owner]
        fresh = np.ones(len(owner), dtype=bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (line[1:] != line[:-1])
        first = np.flatnonzero(fresh)
        bounds, tokens = J.unique_sets(np.cumsum(fresh) - 1, words.hashes(), len(first))
        yield row + owner[first], line[first].astype(np.int32), bounds, tokens


def _fetch(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``e, id, tokens`` of the classes ``(e, doc, line, h)``, from their first lines.

    Lines are gathered per text, so an id that many rows share asks no more of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = [{(x["line"], x["e"]) for x in r} for r in batch.column("lines").to_pylist()]
            for rows, line, bounds, tokens in line_sets(batch.column("text")):
                es = J.set_hashes(bounds, tokens)
                at = [i for i, (r, *place) in enumerate(zip(rows.tolist(), line.tolist(), es.tolist())) if tuple(place) in asked[r]]
                sets = [tokens[bounds[i]:bounds[i + 1]].tobytes() for i in at]
                e = pa.array(es[at])
                yield pa.RecordBatch.from_arrays([e, e, pa.array(sets, pa.binary())], ["e", "id", "tokens"])

    lines, _ = keep(wanted.groupBy("doc", "h").agg(F.collect_set(F.struct("line", "e")).alias("lines")), "wanted")
    # Copies of a row give their lines once.
    texts = documents.select(F.col("doc_id").cast("long").alias("doc"), J.text_hash(F.col("text")).alias("h"), "text")
    rows = J.sieved(texts, lines, "doc", "h").join(lines.hint("merge"), ["doc", "h"]).select("text", "lines")
    return rows.mapInArrow(run, "e long, id long, tokens binary").dropDuplicates(["e"])


def _ordered(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``late, early, n`` of pairs of classes, of which one begins before the other."""
    place = F.struct("doc", "line")
    x = classes.select(F.col("e").alias("a"), place.alias("xs"))
    y = classes.select(F.col("e").alias("b"), place.alias("ys"))
    both = pairs.join(x, "a").join(y, "b").filter("xs <> ys")
    swap = F.col("xs") > F.col("ys")
    return both.select(F.when(swap, F.col("a")).otherwise(F.col("b")).alias("late"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("early"), "n")


def _sets(documents: DataFrame, pairs: DataFrame, classes: DataFrame) -> tuple[DataFrame, str]:
    """``e, id, tokens`` of both classes of all ``pairs``: one pass over the texts."""
    ends = pairs.select(F.col("late").alias("e")).union(pairs.select(F.col("early").alias("e"))).distinct()
    return keep(_fetch(documents, classes.join(ends, "e", "left_semi")), "sets")


def _matched(pairs: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, str]:
    """``e`` of the late classes of ``pairs`` that are similar to their early one."""
    links = J.verify(pairs.select(F.col("late").alias("a"), F.col("early").alias("b")), sets, percent)
    return keep(links.select(F.col("x").alias("e")).distinct(), "later")


def _later(documents: DataFrame, pairs: DataFrame, classes: DataFrame, percent: int) -> tuple[DataFrame, str]:
    """``e`` of the classes that an earlier class of ``pairs`` is similar to.

    One match is enough. Each class is compared with its nearest candidate first, and
    only those that this leaves without a match with their others: in a group of near
    copies nearly all lines are settled by one comparison each, whatever its size.
    """
    sets, sets_at = _sets(documents, pairs, classes)
    nearest = pairs.groupBy("late").agg(F.min_by("early", F.struct("n", "early")).alias("early"))
    nearest, nearest_at = keep(nearest, "nearest")
    later, later_at = _matched(nearest, sets, percent)
    rest = pairs.select("late", "early").join(later.withColumnRenamed("e", "late"), "late", "left_anti")
    rest, rest_at = keep(rest.join(nearest, ["late", "early"], "left_anti"), "rest")
    if not rest.isEmpty():
        more, more_at = _matched(rest, sets, percent)
        both, both_at = keep(later.union(more), "later")
        drop(documents.sparkSession, later_at, more_at)
        later, later_at = both, both_at
    drop(documents.sparkSession, nearest_at, rest_at, sets_at)
    return later, later_at


def _open_pairs(hot: DataFrame, classes: DataFrame, later: DataFrame, percent: int) -> DataFrame:
    """Pairs of a hot token: classes without an earlier match yet, and those before them."""
    once = hot.select("token", F.col("a").alias("e"), "n", "pos", "sig", "more").dropDuplicates(["token", "e"])
    placed = once.join(classes, "e")
    left = placed.join(later, "e", "left_anti").alias("p")
    before = F.struct("q.doc", "q.line") < F.struct("p.doc", "p.line")
    meets = (F.col("p.token") == F.col("q.token")) & before & J.passes_sql(percent, "p", "q")
    found = left.join(placed.alias("q"), meets)
    return found.select(F.col("p.e").alias("late"), F.col("q.e").alias("early"), J.bits_apart("p", "q").alias("n")).dropDuplicates(["late", "early"])


def later_lines(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc, h, line`` of the lines that go; ``h`` is the hash of the line's whole text."""
    spark = documents.sparkSession
    made, _ = keep(J.describe(documents, line_sets), "lines", "kind")
    lines = made.filter("kind = 0").select("doc", "h", "line", "e")
    # Per document first: a line all documents share reduces before it is shuffled.
    per_doc = lines.groupBy("e", "doc").agg(F.min("line").alias("line"), F.min_by("h", "line").alias("h"))
    classes, _ = keep(per_doc.groupBy("e").agg(
        F.min("doc").alias("doc"), F.min_by("line", "doc").alias("line"), F.min_by("h", "doc").alias("h")
    ), "classes")
    rows = J.postings(documents, line_sets, J.frequencies(made), percent)
    found, found_at = keep(J.candidates(rows, percent, COLD), "found", "kind")
    pairs = found.filter(f"kind = {J.PAIR}").select("a", "b", "n").union(J.anchor_pairs(found, percent, COLD)).dropDuplicates(["a", "b"])
    pairs, pairs_at = keep(_ordered(pairs, classes), "pairs")
    later, _ = _later(documents, pairs, classes, percent)
    more = _open_pairs(found.filter(f"kind = {J.HOT}"), classes, later, percent)
    more, more_at = keep(more.join(pairs, ["late", "early"], "left_anti"), "pairs")
    if not more.isEmpty():
        rest, _ = _later(documents, more, classes, percent)
        later = later.union(rest).distinct()
    drop(spark, found_at, pairs_at, more_at)
    first = classes.join(later.withColumn("late", F.lit(True)), "e", "left").select(
        "e", F.struct("doc", "line").alias("first"), F.coalesce("late", F.lit(False)).alias("late")
    )
    return lines.join(first, "e").filter(F.col("late") | (F.struct("doc", "line") > F.col("first"))).select("doc", "h", "line")


@F.arrow_udf(StringType())
def _without(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Texts without the lines of the given numbers."""
    for texts, gone in parts:
        out = texts.to_pylist()
        for r, lines in enumerate(gone.to_pylist()):
            if lines and out[r] is not None:
                lines = set(lines)
                out[r] = "\n".join([x for n, x in enumerate(out[r].split("\n")) if n not in lines])
        yield pa.array(out, pa.string())


def _left(text: Column) -> Column:
    """``text`` without the lines in ``_gone``; whole texts do not go to Python.

    Marked as nondeterministic, so that Spark does not push a filter on the result below it
    and take lines out twice, by two Python workers for each task.
    """
    without = _without.asNondeterministic()
    return F.when(F.col("_gone").isNull(), text).otherwise(without(F.when(F.col("_gone").isNotNull(), text), F.col("_gone")))


def _marked(documents: DataFrame, percent: int) -> DataFrame:
    """``documents`` with ``_gone``, the numbers of the lines to leave out, by id and text."""
    gone = later_lines(documents, percent).groupBy(F.col("doc").alias("_doc"), F.col("h").alias("_h")).agg(F.collect_set("line").alias("_gone"))
    own = (documents["doc_id"] == gone["_doc"]) & (J.text_hash(documents["text"]) == gone["_h"])
    return documents.join(gone, own, "left")


def dedup_lines(documents: DataFrame, percent: int = PERCENT, keep_emptied: bool = True) -> DataFrame:
    """``documents`` with later matching lines taken out of ``text``; ``n_chars`` follows.

    With ``keep_emptied=False`` a document that had words and has none left goes: every
    line of it stands in an earlier document. Documents without a word to begin with stay.
    """
    marked = _marked(documents, percent)
    changed = marked.withColumn("_text", _left(documents["text"]))
    if not keep_emptied:
        wordless = lambda c: ~F.rlike(c, F.lit(r"[^\x20\x09-\x0D]"))
        emptied = F.col("_gone").isNotNull() & wordless(F.col("_text")) & ~wordless(documents["text"])
        changed = changed.filter(~F.coalesce(emptied, F.lit(False)))
    columns = [F.col("_text").alias("text") if c == "text" else F.length("_text").cast("long").alias(c) if c == "n_chars" else documents[c] for c in documents.columns]
    return changed.select(*columns)


def summary(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` of every document."""
    rows = documents.select("doc_id", "text")
    marked = _marked(rows, percent)
    text = F.coalesce("text", F.lit(""))
    breaks = lambda c: (F.octet_length(c) - F.octet_length(F.replace(c, F.lit("\n"), F.lit("")))).cast("long")
    out = marked.select("doc_id", text.alias("text"), "_gone", _left(text).alias("new"))
    return out.select(
        "doc_id", (breaks(F.col("text")) + 1).alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2("new", 256).alias("kept_sha256"),
    )


#: The registered query in DuckDB SQL: prefixes by exact word frequency.
ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line
  FROM documents
), sets AS (
  SELECT *, list_sort(list_distinct(regexp_extract_all(
    translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS e FROM lines
), classes AS (
  SELECT row_number() OVER () AS id, e, len(e) AS n, first FROM (
    SELECT e, min({'doc': doc_id, 'line': line}) AS first FROM sets WHERE len(e) > 0 GROUP BY e)
), words AS (SELECT id, n, unnest(e) AS w FROM classes),
ranked AS (
  SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY c, w) AS r
  FROM words JOIN (SELECT w, count(*) AS c FROM words GROUP BY w) USING (w)
), prefix AS (SELECT id, n, w FROM ranked WHERE r <= n - (80 * n + 99) // 100 + 1),
pairs AS (
  SELECT DISTINCT a.id AS x, b.id AS y FROM prefix a JOIN prefix b
  ON a.w = b.w AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), links AS (
  SELECT x, y, p.first AS f, q.first AS g FROM pairs JOIN classes p ON p.id = x JOIN classes q ON q.id = y
  WHERE 180 * len(list_intersect(p.e, q.e)) >= 80 * (p.n + q.n)
), late AS (
  SELECT DISTINCT CASE WHEN f > g THEN x ELSE y END AS id FROM links WHERE f <> g
), judged AS (
  SELECT s.doc_id, s.line, s.s,
    coalesce(l.id IS NOT NULL OR {'doc': s.doc_id, 'line': s.line} > c.first, false) AS gone
  FROM sets s LEFT JOIN classes c ON c.e = s.e LEFT JOIN late l ON l.id = c.id
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  sha256(coalesce(string_agg(s, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
