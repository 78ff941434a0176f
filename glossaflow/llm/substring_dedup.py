"""Substring dedup: long word passages that occurred before are removed.

A window is ``MIN_WORDS`` consecutive words of one document. A word goes if a window
over it has the same words as one that starts earlier (smaller ``doc_id``, or the same
document and an earlier start); windows are judged on the input.

Windows grow by doubling. Windows of five words are counted first, and only at
anchors: every window of twenty words is represented by the one of its five-word
windows with the smallest hash, so equal windows have equal anchors and a few per
cent of all positions are shuffled. Anchors that are repeated are extended to ten
words, inside the window they stand for; those still repeated are extended to all
twenty words, and of each repeated window all but the earliest are marked. A window of
2L words is hashed from its two halves (which overlap by a word where the length is
odd). Copies that meet in one Arrow batch are combined before they are shuffled, so a
passage that a third of all rows share sends one row per batch to the task of its hash.

A text is known by its id. Where several texts share an id or have none, each gets a
number of its own from a stored table of those texts' 128-bit hashes; the table is
empty where ids are unique.

Defined results: null text counts as empty; documents shorter than a window stay
whole; rows that repeat an id count as one document in the order and neither of two
equal places is earlier; rows without an id come last. Windows are equal where their
64-bit hashes are, after their anchors and extensions were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaflow.llm.tables import drop, keep
from glossaflow.llm.words import Words, blocks, mix, split

MIN_WORDS = 20
LAST = (1 << 63) - 1
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SIDE = np.uint64(0xD6E8FEB86659FD93)
# The place of a window: the number of its text among those of its id, above its first word's.
_PLACE = 31
MOST_TEXTS = 1 << 32

ROWS = "key long, sure int, doc long, place long"


def _join(h: np.ndarray, apart: int) -> np.ndarray:
    """Hashes of longer windows from two shorter ones, ``apart`` words from each other."""
    return mix(h[:-apart] * _STEP + h[apart:]) if len(h) > apart else h[:0]


def _hashes(words: Words, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the windows from each word on, for each size (doubling)."""
    word = words.hashes()
    n, least = len(word), sizes[0]
    first = np.zeros(max(0, n - least + 1), np.uint64)
    for j in range(least):
        first = first * _STEP + word[j:j + len(first)]
    out = [mix(first)]
    for size, longer in zip(sizes, sizes[1:]):
        out.append(_join(out[-1], longer - size))
    return out


def _anchors(h: np.ndarray, spread: int) -> np.ndarray:
    """Where the smallest of ``spread`` neighbours stands, leftmost first."""
    at, k = np.arange(len(h)), 1
    while k < spread:
        # Two runs of k neighbours, side by side or overlapping.
        step = min(k, spread - k)
        if len(h) <= step:
            return at[:0]
        less = h[step:] < h[:-step]
        h, at, k = np.where(less, h[step:], h[:-step]), np.where(less, at[step:], at[:-step]), k + step
    return at


def _levels(total: int) -> tuple[int, int, int]:
    if total < 4:
        raise ValueError("windows have at least four words")
    half = -(-total // 2)
    return -(-half // 2), half, total


def _combine(key: np.ndarray, doc: np.ndarray, place: np.ndarray, first_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch sorted by ``(key, doc, start)``, and which need no shuffle by key.

    With ``first_only`` all but the earliest row of a key are sure to be repeats;
    otherwise every row of a repeated key is, and one is a witness (2) for others.
    """
    start = place & ((1 << _PLACE) - 1)
    order = np.lexsort((start, doc, key))
    key, doc, start = key[order], doc[order], start[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    sure = np.zeros(len(key), np.int32)
    if first_only:
        at = np.flatnonzero(new)[np.cumsum(new) - 1]
        sure[(doc != doc[at]) | (start != start[at])] = 1
    else:
        more = np.diff(np.append(np.flatnonzero(new), len(key)))[np.cumsum(new) - 1] > 1
        sure[more & ~new], sure[more & new] = 1, 2
    return order, sure


def _spread(key: np.ndarray, sure: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Keys to shuffle by; rows already decided are dealt evenly."""
    even = mix(doc.view(np.uint64) * _STEP + place.view(np.uint64)).view(np.int64)
    return np.where(sure == 1, even, key)


def _row_batch(**columns) -> pa.RecordBatch:
    names = list(columns)
    return pa.RecordBatch.from_arrays([pa.array(columns[n]) for n in names], names)


def _repeats(rows: DataFrame, first_only: bool) -> DataFrame:
    """Rows whose key is repeated; with ``first_only`` without each key's earliest."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, leader = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {c: batch.column(c).to_numpy() for c in names}
            if first_only:
                yield from firsts(x, leader)
                leader = lead(x, leader)
                continue
            if held is not None:
                x = {c: np.concatenate([held[c], x[c]]) for c in names}
            same = x["key"][1:] == x["key"][:-1]
            live = (x["sure"] > 0) | np.append(same, False)
            live[1:] |= same
            # Whether the last row is repeated shows in the next batch.
            yield _row_batch(**{c: v[:-1][live[:-1]] for c, v in x.items()})
            held = {c: v[-1:].copy() for c, v in x.items()}
            held["sure"] = np.maximum(held["sure"], live[-1:].astype(np.int32))
        if held is not None and held["sure"][0] > 0:
            yield _row_batch(**held)

    def place_of(x):
        return x["place"] & ((1 << _PLACE) - 1)

    def lead(x, leader):
        """The earliest row of the last undecided key so far."""
        at = np.flatnonzero(x["sure"] == 0)
        if not len(at):
            return leader
        key = x["key"][at[-1]]
        if leader is not None and leader[0] == key:
            return leader
        first = at[np.flatnonzero(x["key"][at] == key)[0]]
        return key, x["doc"][first], place_of(x)[first]

    def firsts(x, leader):
        at = np.flatnonzero(x["sure"] == 0)
        key, doc, start = x["key"][at], x["doc"][at], place_of(x)[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(at) else at
        fd, fs = doc[head], start[head]
        if leader is not None and len(at):
            mine = key == leader[0]
            fd, fs = np.where(mine, leader[1], fd), np.where(mine, leader[2], fs)
        later = np.zeros(len(x["sure"]), dtype=bool)
        later[at] = (doc != fd) | (start != fs)
        later |= x["sure"] == 1
        yield _row_batch(**{c: v[later] for c, v in x.items()})

    start = F.col("place").bitwiseAND(F.lit((1 << _PLACE) - 1))
    ordered = rows.repartition("key").sortWithinPartitions("key", "doc", start)
    return ordered.mapInArrow(run, rows.schema)


def _texts(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``doc`` (order), ``text``, and two hashes of the text."""
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return documents.select(
        doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST)).alias("doc"), text.alias("text"),
        F.xxhash64(text).alias("_h"), F.xxhash64(F.lit("second"), text).alias("_g"),
    )


def _numbers(documents: DataFrame) -> tuple[DataFrame, str]:
    """``doc, _h, _g, print``: numbers from 1 for the texts of ids that have several.

    Numbers run through (id, hashes) in runs of bounded size, however many texts one id has.
    """
    texts = _texts(documents).drop("doc_id", "text")
    unlike = [F.min(h) != F.max(h) for h in ("_h", "_g")]
    several = texts.groupBy("doc").agg((unlike[0] | unlike[1]).alias("_several")).filter("_several").select("doc")
    known = texts.join(several, "doc").distinct()
    order = ("doc", "_h", "_g")
    ranged = known.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged, path = keep(ranged.withColumn("_at", F.monotonically_increasing_id()), "texts")
    # Rows before a partition, from one count for each.
    part = F.shiftright("_at", 33)
    sizes = sorted(map(tuple, ranged.groupBy(part).count().collect()))
    before, total = {}, 0
    for number, n in sizes:
        before[number] = total + 1 - (number << 33)
        total += n
    if total >= MOST_TEXTS:
        raise ValueError("too many texts share their ids")
    shifts = F.map_from_arrays(F.array(*map(F.lit, before)), F.array(*map(F.lit, before.values()))) if before else None
    number = (F.col("_at") + F.element_at(shifts, part)).cast("long") if before else F.lit(0).cast("long")
    return ranged.select(*order, number.alias("print")), path


def _keyed(documents: DataFrame, numbers: DataFrame) -> DataFrame:
    """``doc_id, doc, text`` and ``print``, the text's number among those of its id."""
    joined = _texts(documents).join(numbers, ["doc", "_h", "_g"], "left")
    return joined.select("doc_id", "doc", F.coalesce("print", F.lit(0).cast("long")).alias("print"), "text")


def _places(doc_rows: np.ndarray, prints: np.ndarray, words: Words, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return (prints[doc_rows] << _PLACE) | (at - words.bounds[owner])


def _anchor_rows(keyed: DataFrame, total: int) -> DataFrame:
    """Anchors of all windows, with the hashes of their two extensions."""
    least, half, _ = _levels(total)
    schema = ROWS + ", right long, left long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints = (batch.column(c).to_numpy() for c in ("doc", "print"))
            parts: list[list[np.ndarray]] = []
            for row, data, offsets in blocks(batch.column("text")):
                words = split(data, offsets)
                h5, h10 = _hashes(words, (least, half))
                starts = words.windows(total)
                at = np.unique(_anchors(h5, total - least + 1)[starts])
                owner = np.searchsorted(words.bounds, at, "right") - 1
                rows = row + owner
                pad = np.append(h10, np.zeros(half, np.uint64))
                right = mix(pad[at] + _SIDE)
                left = mix(pad[np.maximum(at - (half - least), 0)])
                # An extension that leaves the document has no hash.
                right[at + half > words.bounds[owner + 1]] = 0
                left[at - (half - least) < words.bounds[owner]] = 0
                parts.append([h5[at].view(np.int64), ids[rows], _places(rows, prints, words, at, owner), right.view(np.int64), left.view(np.int64)])
            if not parts:
                continue
            key, doc, place, right, left = map(np.concatenate, zip(*parts))
            order, sure = _combine(key, doc, place, False)
            key, doc, place = key[order], doc[order], place[order]
            yield _row_batch(key=_spread(key, sure, doc, place), sure=sure, doc=doc, place=place, right=right[order], left=left[order])

    return keyed.mapInArrow(run, schema)


def _extended(found: DataFrame) -> DataFrame:
    """The two extensions of each repeated anchor, combined per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {c: batch.column(c).to_numpy() for c in ("doc", "place", "right", "left")}
            key = np.concatenate([x["right"], x["left"]])
            doc, place = np.tile(x["doc"], 2), np.tile(x["place"], 2)
            side = np.repeat(np.array([0, 1], np.int32), len(x["doc"]))
            some = np.flatnonzero(key)
            order, sure = _combine(key[some], doc[some], place[some], False)
            some = some[order]
            key, doc, place = key[some], doc[some], place[some]
            yield _row_batch(key=_spread(key, sure, doc, place), sure=sure, doc=doc, place=place, side=side[some])

    return found.mapInArrow(run, ROWS + ", side int")


def _by_document(rows: DataFrame, value: Column, label: str) -> DataFrame:
    mask = F.lit((1 << _PLACE) - 1)
    split_up = rows.select(
        "doc", F.shiftrightunsigned("place", _PLACE).alias("print"), F.col("place").bitwiseAND(mask).alias("start"), value.alias("v")
    )
    # Sets combine before the shuffle, so the copies of a row add nothing.
    return split_up.groupBy("doc", "print").agg(F.collect_set((F.col("start") * 2 + F.col("v")).cast("long")).alias(label))


def _window_rows(joined: DataFrame, total: int) -> DataFrame:
    """All windows whose anchor's extension is repeated."""
    least, half, _ = _levels(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints = (batch.column(c).to_numpy() for c in ("doc", "print"))
            live = batch.column("live")
            at, flat = live.offsets.to_numpy().astype(np.int64), live.values.to_numpy()
            parts = []
            for row, data, offsets in blocks(batch.column("text")):
                words = split(data, offsets)
                h5, h10, h20 = _hashes(words, (least, half, total))
                starts = words.windows(total)
                anchor = _anchors(h5, total - least + 1)[starts]
                n = len(offsets) - 1
                mine = flat[at[row]:at[row + n]]
                rows = np.repeat(np.arange(n), np.diff(at[row:row + n + 1]))
                sides = np.zeros((2, len(words.starts) + 1), dtype=bool)
                sides[mine & 1, (mine >> 1) + words.bounds[rows]] = True
                right = anchor - starts <= total - half
                starts = starts[np.where(right, sides[0, anchor], sides[1, anchor])]
                owner = np.searchsorted(words.bounds, starts, "right") - 1
                parts.append([h20[starts].view(np.int64), ids[row + owner], _places(row + owner, prints, words, starts, owner)])
            if not parts:
                continue
            key, doc, place = map(np.concatenate, zip(*parts))
            order, sure = _combine(key, doc, place, True)
            key, doc, place = key[order], doc[order], place[order]
            yield _row_batch(key=_spread(key, sure, doc, place), sure=sure, doc=doc, place=place)

    return joined.mapInArrow(run, ROWS)


def _ranges(rows: DataFrame, total: int) -> DataFrame:
    """``doc, print, begins, ends``: the word ranges that a document's repeats cover."""
    starts = _by_document(rows, F.lit(0), "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins, ends = [], []
            for s in batch.column("starts"):
                s = np.unique(s.values.to_numpy() >> 1)
                gap = np.flatnonzero(np.diff(s) > total) + 1
                begins.append(s[np.append(0, gap)])
                ends.append(s[np.append(gap - 1, len(s) - 1)] + total)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("print"), pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))],
                ["doc", "print", "begins", "ends"],
            )

    return starts.mapInArrow(run, "doc long, print long, begins array<long>, ends array<long>")


def repeated_ranges(keyed: DataFrame, total: int = MIN_WORDS) -> DataFrame:
    """Word ranges to remove, per ``(doc, print)`` of :func:`_keyed`."""
    spark, keyed = keyed.sparkSession, keyed.drop("doc_id")
    anchors, a = keep(_repeats(_anchor_rows(keyed, total), False).select("doc", "place", "right", "left"), "anchors")
    extended, b = keep(_repeats(_extended(anchors), False).select("doc", "place", "side"), "extended")
    drop(spark, a)
    live = _by_document(extended, F.col("side"), "live")
    joined = keyed.join(live, ["doc", "print"]).select("doc", "print", "text", "live")
    later, c = keep(_repeats(_window_rows(joined, total), True).select("doc", "place"), "windows")
    drop(spark, b)
    out, _ = keep(_ranges(later, total), "ranges")
    drop(spark, c)
    return out


def dedup_substrings(documents: DataFrame, total: int = MIN_WORDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: the kept words, joined by one space."""
    keyed = _keyed(documents, _numbers(documents)[0])
    ranges = repeated_ranges(keyed, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, kept = [], [], []
            begins, ends = batch.column("begins"), batch.column("ends")
            for i, text in enumerate(batch.column("text")):
                words = text.as_buffer().to_pybytes().split()
                counts.append(len(words))
                if begins[i].is_valid:
                    for a, b in zip(reversed(begins[i].as_py()), reversed(ends[i].as_py())):
                        del words[a:b]
                gone.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    joined = keyed.join(ranges, ["doc", "print"], "left").select("doc_id", "text", "begins", "ends")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


#: The registered query in DuckDB SQL: every window as a string.
ORACLE_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM texts WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT doc_id, i, unnest(range(0, 20)) AS j FROM later)
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM texts
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(g.pos) AS n_removed,
    string_agg(word, ' ' ORDER BY words.pos) FILTER (WHERE g.pos IS NULL) AS text
  FROM words LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
