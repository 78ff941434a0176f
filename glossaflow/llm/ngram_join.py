"""N-gram Jaccard join: documents that share most of their word n-grams.

A document's set is its distinct five-word shingles (A-Z folded); with fewer
words, the whole sequence as one; without words or with null text, empty. Sets
of similarity 0.8 or more are linked. Copies are joined as one set, links are found
by prefix filtering (:mod:`glossaflow.llm.prefix_join`), and classes are the
connected components of the links. Sets are fetched for those pairs only that bitmaps
of the sets' own sizes leave open, since long documents with a passage in common pass
every filter of fixed size.

Shingles and sets are compared by 64-bit hashes. Defined results: an empty set is
its own class; rows without ``doc_id`` have no class (null) and take part in no link;
rows that repeat an id are one document each and share that id's place in a class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaflow.llm import prefix_join as J
from glossaflow.llm.components import components
from glossaflow.llm.tables import drop, keep
from glossaflow.llm.words import blocks, split, window_hashes

WORDS, PERCENT = 5, 80
# Sets of one shingle that are compared all with all.
COLD = 4


def shingle_sets(size: int = WORDS) -> J.Extractor:
    """Extractor of one set per text."""

    def extract(texts: pa.Array) -> Iterator[J.Sets]:
        for row, data, offsets in blocks(texts):
            words = split(data, offsets, lower=True)
            n, count = len(offsets) - 1, np.diff(words.bounds)
            hashes = words.hashes()
            first = words.windows(size)
            tokens, owner = window_hashes(hashes, first, size), words.owner[first]
            for k in range(1, size):
                few = np.flatnonzero(count == k)
                tokens = np.concatenate([tokens, window_hashes(hashes, words.bounds[few], k) + np.uint64(k)])
                owner = np.concatenate([owner, few])
            bounds, tokens = J.unique_sets(owner, tokens, n)
            yield np.arange(row, row + n), np.zeros(n, np.int32), bounds, tokens

    return extract


def _fetch(documents: DataFrame, wanted: DataFrame, extract: J.Extractor) -> DataFrame:
    """``e, id, tokens`` of the sets ``e`` wanted of each document ``id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asked = batch.column("id"), batch.column("es").to_pylist()
            for rows, _, bounds, tokens in extract(batch.column("text")):
                es = J.set_hashes(bounds, tokens)
                at = [i for i, (r, e) in enumerate(zip(rows.tolist(), es.tolist())) if e in asked[r]]
                sets = [tokens[bounds[i]:bounds[i + 1]].tobytes() for i in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(es[at]), ids.take(pa.array(rows[at])), pa.array(sets, pa.binary())], ["e", "id", "tokens"]
                )

    # Per text, so an id that many rows share asks no more of them; copies give a set once.
    es, _ = keep(wanted.groupBy("id", "h").agg(F.collect_set("e").alias("es")), "wanted")
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), J.text_hash(F.col("text")).alias("h"), "text")
    rows = J.sieved(texts, es, "id", "h").join(es.hint("merge"), ["id", "h"])
    return rows.select("id", "text", "es").mapInArrow(run, "e long, id long, tokens binary").dropDuplicates(["e"])


def _links(documents: DataFrame, pairs: DataFrame, classes: DataFrame, extract: J.Extractor, percent: int) -> DataFrame:
    """Verified pairs as ids of their classes' first documents."""
    ends = pairs.select(F.col("a").alias("e")).union(pairs.select("b")).distinct()
    wanted = classes.join(ends, "e", "left_semi").select("id", "h", "e")
    held, at = keep(_fetch(documents, wanted, extract), "sets")
    links, out = keep(J.verify(pairs, held, percent), "links")
    drop(documents.sparkSession, at)
    return links, out


def _open_pairs(hot: DataFrame, classes: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of a hot token whose sets are still in different components.

    The token's largest component meets the others; it is not paired with itself.
    """
    once = hot.select("token", F.col("a").alias("e"), "n", "pos", "sig", "more").dropDuplicates(["token", "e"])
    rooted = (
        once.join(classes.select("e", "id"), "e").join(roots.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("root", F.coalesce("root", "id"))
    )
    sizes = rooted.groupBy("token", "root").agg(F.count("*").alias("c"))
    main = sizes.groupBy("token").agg(F.max_by("root", "c").alias("main"), F.count("*").alias("k")).filter("k > 1")
    mixed = rooted.join(main.select("token", "main"), "token")
    few = mixed.filter("root <> main").alias("p")
    every = mixed.alias("q")
    meets = (
        (F.col("p.token") == F.col("q.token")) & (F.col("p.root") != F.col("q.root"))
        & ((F.col("q.root") == F.col("q.main")) | (F.col("p.root") < F.col("q.root")))
        & J.passes_sql(percent, "p", "q")
    )
    return few.join(every, meets).select(F.least("p.e", "q.e").alias("a"), F.greatest("p.e", "q.e").alias("b")).distinct()


def near_duplicates(documents: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``documents``."""
    spark, extract = documents.sparkSession, shingle_sets(size)
    made, made_at = keep(J.describe(documents, extract, with_bitmaps=True), "sets", "kind")
    described = made.filter("kind = 0").select(F.col("doc").alias("doc_id"), "n", "e", "h")
    counts = J.frequencies(made)
    classes, classes_at = keep(
        described.filter("n > 0").groupBy("e").agg(
            F.min("doc_id").alias("id"), F.max("n").alias("n"), F.min_by("h", "doc_id").alias("h")
        ), "classes"
    )
    found, found_at = keep(J.candidates(J.postings(documents, extract, counts, percent), percent, COLD), "found", "kind")
    anchors = J.anchor_pairs(found, percent, COLD).select("a", "b")
    pairs = found.filter(f"kind = {J.PAIR}").select("a", "b").union(anchors).distinct()
    pairs, pairs_at = keep(pairs, "pairs")
    near, near_at = keep(J.near(pairs, made, percent), "near")
    links, links_at = _links(documents, near, classes, extract, percent)
    roots = components(links)
    # Pairs that failed are not verified again.
    more = _open_pairs(found.filter(f"kind = {J.HOT}"), classes, roots, percent)
    more, more_at = keep(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        open_, open_at = keep(J.near(more, made, percent), "near")
        rest, rest_at = _links(documents, open_, classes, extract, percent)
        roots = components(links.union(rest))
        drop(spark, open_at, rest_at)
    drop(spark, found_at, pairs_at, near_at, more_at, links_at)
    named = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").select("e", F.coalesce("root", "id").alias("root"))
    out = described.join(named, "e", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    return out.union(_without_id(documents, extract))


def _without_id(documents: DataFrame, extract: J.Extractor) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, bounds, _ in extract(batch.column(0)):
                none = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(np.diff(bounds)), none], ["doc_id", "n_shingles", "component_id"])

    missing = documents.filter(F.col("doc_id").isNull()).select("text")
    return missing.mapInArrow(run, "doc_id long, n_shingles long, component_id long")


def keep_one(documents: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each class (that of the smallest id), with its own columns.

    Each row is judged by its own text: rows that share an id and have different texts
    are documents of their own, the smallest hash of id and text being the first of one
    id. Of rows that share id and text one stays; rows without an id all stay.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), "text")
    known = documents.filter(F.col("doc_id").isNotNull())
    keyed = known.select(F.col("doc_id").alias("_id"), "text", key.alias("doc_id"))
    found = near_duplicates(keyed.select("doc_id", "text"), size, percent).filter("n_shingles > 0").select("doc_id", "component_id").distinct()
    members, at = keep(found.join(keyed.select("doc_id", "_id").distinct(), "doc_id"), "members")
    first = members.groupBy("component_id").agg(F.min_by("doc_id", F.struct("_id", "doc_id")).alias("_first"))
    gone, gone_at = keep(members.join(first, "component_id").filter("doc_id <> _first").select(F.col("doc_id").alias("_gone")), "gone")
    drop(documents.sparkSession, at)
    own = known.withColumn("_key", key)
    stay = own.join(gone, own["_key"] == gone["_gone"], "left_anti").dropDuplicates(["_key"]).drop("_key")
    return documents.filter(F.col("doc_id").isNull()).union(stay)


#: The registered query in DuckDB SQL: all pairs that share a shingle, and their closure.
ORACLE_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM texts WHERE len(w) >= 5)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM texts WHERE len(w) BETWEEN 1 AND 4)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * shared.n >= 80 * (p.n + q.n - shared.n)
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION SELECT e.y, r.root FROM reach r JOIN edges e ON e.x = r.node
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) r ON r.node = d.doc_id
"""
