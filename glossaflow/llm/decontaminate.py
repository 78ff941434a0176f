"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance.

Texts and benchmark items are compared as sequences of words (A-Z folded). A text is
contaminated by an item if some passage of it is within ``EDITS`` word edits per
item word. The random walk of Chakraborty, Goldenberg and Koucky (2016) copies the
word under its pointer at every step and moves on or not by a hash bit of (step,
word); two sequences few edits apart walk in step again soon, so their copies differ
in few places. Each repetition has its own walk and samples a few of the steps as
its key.

Items fall into size classes. Windows of the class width start at every
``width / 4``-th word of a text; an item is embedded at each of its words, so any
passage lines up with some windows. Each band of item lengths has the smallest number
of repetitions that finds edited copies of all its items with the target recall.
Bands that miss it in ``MOST_REPEATS`` are searched exactly: of ``k + 1`` pieces of an
item, ``k`` edits leave one whole, which is looked up at every word of the texts.
Candidates are verified with the exact edit distance of the item to the best passage
around.

Distinct item texts are broadcast in blocks of bounded size, one pass over the texts per
block, and item ids are joined to the hits.
Defined results: null or empty texts have no hits; items without words never match;
rows that repeat an item id are items of their own; every row of ``documents``
counts, whatever its id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from glossaflow.llm.tables import keep
from glossaflow.llm.words import Words, blocks, mix, split, window_hashes

EDITS = 0.2
RECALL = 0.95
WIDTHS = (1, 2, 4, 8, 16)
SAMPLED = 8
MOST_REPEATS = 16
# Edited copies that a band's recall is measured on, at least; each item has one or more.
COPIES = 400
# Longer items count as this long when recall is measured: more windows find more.
LONGEST_BAND = 960
# Candidates of pieces that are compared at a time.
CANDIDATES = 1 << 18
ITEM_BLOCK_BYTES = 8 << 20
_BITS = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)

HITS = ArrayType(StructType([
    StructField("item", StringType()), StructField("edits", IntegerType()),
    StructField("item_words", IntegerType()), StructField("start_word", IntegerType()),
]))

_ARROW_HITS = pa.list_(pa.struct([
    ("item", pa.string()), ("edits", pa.int32()), ("item_words", pa.int32()), ("start_word", pa.int32()),
]))


def stride(width: int) -> int:
    return max(1, width // 4)


def width_of(n: int) -> int:
    """Class width of an item of ``n`` words: some aligned window lies inside it."""
    return max(w for w in WIDTHS if w == 1 or w + stride(w) - 1 <= n)


def band_of(n: int) -> int:
    """Shortest length of the band of ``n`` words: ``n`` itself, or a multiple of five from 60 on."""
    if n < 60:
        return n
    step = 5 << (n.bit_length() - 6)
    return min(LONGEST_BAND, n // step * step)


def pieces(n: int, edits: int) -> list[tuple[int, int]]:
    """``(offset, words)`` of ``edits + 1`` pieces of ``n`` words, even but for one word."""
    cuts = [n * k // (edits + 1) for k in range(edits + 2)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:])]


def walk(hashes: np.ndarray, starts: np.ndarray, width: int, repeat: int) -> np.ndarray:
    """Keys of the windows at ``starts``: sampled words of one random walk."""
    rng = np.random.default_rng([width, repeat])
    shifts = rng.permutation(64)[:width].astype(np.uint64)
    sampled = set(rng.permutation(width)[:SAMPLED].tolist())
    own = mix(hashes ^ np.uint64(rng.integers(1 << 62)))
    at, key = starts.copy(), np.full(len(starts), repeat, np.uint64)
    for step in range(max(sampled) + 1):
        word = own[at]
        if step in sampled:
            key = key * _STEP + word
        at += ((word >> shifts[step]) & np.uint64(1)).astype(np.int64)
    return mix(key)


def fewest_edits(item: np.ndarray, text: np.ndarray, from_first: bool = False) -> tuple[int, int]:
    """Edit distance of ``item`` to the nearest passage of ``text``, and that passage's end.

    ``from_first`` takes passages that begin with the text's first word only.
    """
    ramp = np.arange(len(text) + 1)
    row = ramp.astype(np.int64) if from_first else np.zeros(len(text) + 1, np.int64)
    for i, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
    end = int(np.argmin(row))
    return int(row[end]), end


class Items:
    """A block of benchmark items, indexed by the keys of their windows."""

    def __init__(self, ids: list, texts: list[str], recall: float = RECALL, edits: float = EDITS):
        self.edits, self.ids, self.words = edits, [], []
        for i, data, offsets in blocks(pa.array(texts, pa.string())):
            found = split(data, offsets, lower=True)
            hashes = found.hashes()
            for k, (a, b) in enumerate(zip(found.bounds[:-1], found.bounds[1:])):
                if b > a:
                    self.ids.append(ids[i + k])
                    self.words.append(hashes[a:b])
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.widths = np.array([width_of(n) for n in self.lengths.tolist()], np.int64)
        bands = np.array([band_of(n) for n in self.lengths.tolist()], np.int64)
        #: Repetitions of each item; 0 for items that are searched exactly.
        self.repeats = np.zeros(len(self.words), np.int64)
        for band in sorted(set(bands.tolist())):
            own = np.flatnonzero(bands == band)
            self.repeats[own] = self._repeats(own, band, recall)
        self.tables: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
        for width in sorted(set(self.widths.tolist())):
            for repeat in range(self.repeats[self.widths == width].max()):
                self.tables[width, repeat] = self._table(width, repeat)
        self.pieces = self._pieces(np.flatnonzero(self.repeats == 0))

    @staticmethod
    def _indexed(keys: list, owner: list, offset: list) -> tuple[np.ndarray, ...]:
        keys, owner, offset = map(np.concatenate, (keys, owner, offset))
        order = np.argsort(keys, kind="stable")
        bits = np.zeros(_BITS, dtype=bool)
        bits[keys & np.uint64(_BITS - 1)] = True
        return keys[order], owner[order], offset[order], bits

    def _table(self, width: int, repeat: int) -> tuple[np.ndarray, ...]:
        keys, owner, offset = [], [], []
        for k in np.flatnonzero((self.widths == width) & (self.repeats > repeat)).tolist():
            at = np.arange(len(self.words[k]) - width + 1)
            keys.append(walk(self.words[k], at, width, repeat))
            owner.append(np.full(len(at), k))
            offset.append(at)
        return self._indexed(keys, owner, offset)

    def _pieces(self, items: np.ndarray) -> dict[int, tuple[np.ndarray, ...]]:
        """Pieces of the items by their number of words."""
        found: dict[int, tuple[list, list, list]] = {}
        for k in items.tolist():
            n = len(self.words[k])
            for at, size in pieces(n, int(self.edits * n)):
                keys, owner, offset = found.setdefault(size, ([], [], []))
                keys.append(window_hashes(self.words[k], np.array([at]), size))
                owner.append([k])
                offset.append([at])
        return {size: self._indexed(*lists) for size, lists in sorted(found.items())}

    def _repeats(self, own: np.ndarray, band: int, recall: float) -> int:
        """Repetitions that find edited copies of all items of a band; 0 if too many."""
        width, rng = width_of(band), np.random.default_rng(band)
        items = np.stack([self.words[k][:band] for k in own.tolist()])
        copied = np.tile(np.arange(len(items)), -(-COPIES // len(items)))
        copies, bounds = self._edited(items[copied], width, rng)
        owner = np.repeat(np.arange(len(copied)), np.diff(bounds))
        rank = np.arange(len(copies)) - bounds[owner] + rng.integers(stride(width), size=len(copied))[owner]
        starts = np.flatnonzero((bounds[owner + 1] - np.arange(len(copies)) >= width) & (rank % stride(width) == 0))
        inner = (np.arange(len(items))[:, None] * band + np.arange(band - width + 1)).ravel()
        item = lambda of: of.astype(np.uint64) * _STEP
        found = np.zeros(len(copied), dtype=bool)
        for repeat in range(MOST_REPEATS):
            wanted = walk(items.ravel(), inner, width, repeat) ^ item(inner // band)
            seen = walk(copies, starts, width, repeat) ^ item(copied[owner[starts]])
            found[owner[starts[np.isin(seen, wanted)]]] = True
            if found.mean() >= recall:
                return repeat + 1
        return 0

    def _edited(self, items: np.ndarray, around: int, rng) -> tuple[np.ndarray, np.ndarray]:
        """Each row with as many word edits as the threshold allows, other words around it."""
        m, n = items.shape
        fresh = lambda *shape: rng.integers(1 << 62, size=shape).astype(np.uint64)
        words = np.hstack([fresh(m, around), items, fresh(m, around)])
        edited = np.zeros(words.shape, dtype=bool)
        edited[:, around:around + n] = rng.random((m, n)).argsort(1).argsort(1) < int(self.edits * n)
        # A word is deleted, replaced, or gets another word before it.
        size = np.where(edited, rng.integers(3, size=words.shape), 1)
        kind, edited = size.ravel(), edited.ravel()
        out = np.repeat(words.ravel(), kind)
        first = np.cumsum(kind) - kind
        new = first[edited & (kind > 0)]
        out[new] = fresh(len(new))
        return out, np.concatenate(([0], np.cumsum(size.sum(1))))

    def hits(self, texts: pa.Array) -> list[list[dict]]:
        """Per text, each item that matches: its fewest edits and where."""
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        for row, data, offsets in blocks(texts):
            words = split(data, offsets, lower=True)
            hashes, owner = words.hashes(), words.owner
            ranks = np.arange(len(owner)) - words.bounds[owner]
            asked: set[tuple[int, int, int]] = set()
            for width in sorted({w for w, _ in self.tables}):
                repeats = sum(w == width for w, _ in self.tables)
                starts = words.windows(width)
                starts = starts[ranks[starts] % stride(width) == 0]
                for repeat in range(repeats):
                    keys, item, offset, bits = self.tables[width, repeat]
                    found = walk(hashes, starts, width, repeat)
                    some = np.flatnonzero(bits[found & np.uint64(_BITS - 1)])
                    lo = np.searchsorted(keys, found[some])
                    hi = np.searchsorted(keys, found[some], "right")
                    for s, a, b in zip(starts[some].tolist(), lo.tolist(), hi.tolist()):
                        for k in range(a, b):
                            asked.add((int(owner[s]), int(item[k]), s - int(offset[k])))
            for item, at, doc in self._near_pieces(hashes, owner, words):
                asked.update(zip(doc.tolist(), item.tolist(), at.tolist()))
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for doc, item, at in sorted(asked):
                near = self._verify(hashes, words.bounds[doc], words.bounds[doc + 1], item, at)
                if near is not None and near < best.get((doc, item), (1 << 30, 0)):
                    best[doc, item] = near
            for (doc, item), (edits, end) in sorted(best.items()):
                # Backwards from the passage's end, the nearest passage ends where it begins.
                own, first = self.words[item], words.bounds[doc]
                reach = max(0, end - len(own) - edits)
                _, back = fewest_edits(own[::-1], hashes[first + reach:first + end][::-1], from_first=True)
                out[row + doc].append({
                    "item": self.ids[item], "edits": edits, "item_words": len(own), "start_word": int(end - back),
                })
        return out

    def _near_pieces(self, hashes: np.ndarray, owner: np.ndarray, words: Words) -> Iterator[tuple[np.ndarray, ...]]:
        """``item, place, text`` where a piece occurs and enough other words of the item may."""
        for size, (keys, items, offset, bits) in self.pieces.items():
            starts = words.windows(size)
            found = window_hashes(hashes, starts, size)
            some = np.flatnonzero(bits[found & np.uint64(_BITS - 1)])
            lo, hi = np.searchsorted(keys, found[some]), np.searchsorted(keys, found[some], "right")
            total = np.concatenate(([0], np.cumsum(hi - lo)))
            for first in range(0, int(total[-1]), CANDIDATES):
                k = np.arange(first, min(first + CANDIDATES, int(total[-1])))
                row = np.searchsorted(total, k, "right") - 1
                entry = lo[row] + k - total[row]
                s, item = starts[some[row]], items[entry]
                at = s - offset[entry]
                near = self._close(hashes, words.bounds[owner[s]], words.bounds[owner[s] + 1], item, at)
                yield item[near], at[near], owner[s[near]]

    def _close(self, hashes, first, last, item, at) -> np.ndarray:
        """Whether all but the allowed edits of an item's words occur near their places.

        Where a piece is whole, the other words that stay are moved by no more places
        than there are edits.
        """
        ok = np.zeros(len(item), dtype=bool)
        for n in np.unique(self.lengths[item]).tolist():
            own = np.flatnonzero(self.lengths[item] == n)
            most = int(self.edits * n)
            known, of = np.unique(item[own], return_inverse=True)
            words = np.stack([self.words[k] for k in known.tolist()])
            alike = np.zeros(len(own), np.int64)
            for i in range(n):
                here = np.zeros(len(own), dtype=bool)
                for move in range(-most, most + 1):
                    place = at[own] + i + move
                    inside = (place >= first[own]) & (place < last[own])
                    here |= inside & (hashes[np.where(inside, place, 0)] == words[of, i])
                alike += here
            ok[own] = alike >= n - most
        return ok

    def _verify(self, hashes, first, last, item, at) -> tuple[int, int] | None:
        words = self.words[item]
        most = int(self.edits * len(words))
        lo, hi = max(first, at - most), min(last, at + len(words) + most)
        edits, end = fewest_edits(words, hashes[lo:hi])
        return (edits, int(lo - first + end)) if edits <= most else None


def _finder(shared: Broadcast):
    @F.arrow_udf(HITS)
    def find(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array(shared.value.hits(texts), _ARROW_HITS)

    return find


def _known(benchmark: DataFrame) -> DataFrame:
    """``item_id, item, text`` of the items, ``item`` being the text's digest."""
    known = benchmark.filter(F.col("text").isNotNull())
    return known.select(F.col("item_id").cast("long"), F.sha2("text", 256).alias("item"), "text")


def _finders(documents: DataFrame, benchmark: DataFrame, recall: float, edits: float) -> list:
    """One function ``text -> hits`` per block of distinct items."""
    spark = documents.sparkSession
    known = _known(benchmark).select("item", "text").distinct()
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = 1 + size // ITEM_BLOCK_BYTES
    out = []
    for k in range(count):
        part = known.filter(F.pmod(F.xxhash64("item"), F.lit(count)) == k) if count > 1 else known
        rows = part.orderBy("item").collect()
        shared = spark.sparkContext.broadcast(Items([r["item"] for r in rows], [r["text"] for r in rows], recall, edits))

        out.append(_finder(shared))
    return out


def contaminated(documents: DataFrame, benchmark: DataFrame, recall: float = RECALL, edits: float = EDITS) -> DataFrame:
    """``doc_id, item_id, edits, item_words, start_word`` of every match."""
    passes = []
    for find in _finders(documents, benchmark, recall, edits):
        rows = documents.select("doc_id", find(documents["text"]).alias("_hits")).filter(F.size("_hits") > 0)
        passes.append(rows.select("doc_id", F.explode("_hits").alias("h")).select("doc_id", "h.*"))
    named = reduce(DataFrame.union, passes).join(_known(benchmark).select("item", "item_id"), "item")
    return named.select("doc_id", "item_id", "edits", "item_words", "start_word")


def clean(documents: DataFrame, benchmark: DataFrame, recall: float = RECALL, edits: float = EDITS) -> DataFrame:
    """The documents without a match, with their own columns."""
    finders = _finders(documents, benchmark, recall, edits)
    for find in finders:
        documents = documents.filter(F.size(find(documents["text"])) == 0)
        if len(finders) > 1:
            documents, _ = keep(documents, "clean")
    return documents
