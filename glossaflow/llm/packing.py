"""Packing token sequences into windows by minimum bin slack.

Texts are tokenised word by word with a cache of words, and closed with an end id,
where a tokenizer's ids do not depend on what stands beyond white space, or beyond the
border between a letter and closing signs. Other tokenizers (found by probes, such as
those whose ids hold the space before a word) encode whole texts. Texts
longer than a window are cut into full windows and a rest. Only the number of rests
per length reaches the driver: at most ``window`` numbers. There a bitset
subset-sum over the remaining lengths finds the multiset that fills a window
closest to its capacity, next to the longest rest left, is traced back to counts,
and is used as often as the counts allow. Each use leaves some length with fewer
than ``window / length`` rests, so the number of patterns is bounded by about
``window * ln(window)``, whatever the input.

Defined results: null text counts as empty and is one piece that holds the end id;
rows with null or repeated ids are documents of their own.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossaflow.llm.tables import keep
from glossaflow.llm.words import Words, blocks, cut_tails, split

WINDOW, END_ID = 4_096, 2
CACHED_WORDS = 150_000
# Words that are encoded as one text, and the sign that is put between them.
JOINED_WORDS, SEPARATOR = 512, "\x01"
BUCKET_ROWS = 2_048
# Bytes of texts that are encoded together; their words are looked up once.
BLOCK_BYTES = 1 << 21

# Signs that start a unit of their own behind a letter (not those of special tokens).
_TAIL = np.zeros(256, dtype=bool)
_TAIL[[ord(c) for c in ".,;:!?%&*$#"]] = True

# Texts that tell tokenizers apart whose ids depend on their neighbours.
_PROBES = ("a b", "the  end", "Ab, cd. Ef!", "x\ty\nz", " lead", "trail \n", "é ü, 天 b", "5 % of $7 & #8", "it's a-b c_d")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordEncoder:
    """Token ids of words, remembered for the life of a Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._kind = np.dtype("<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # Words met lately, and those met before them: frequent words are never forgotten.
        self._known: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}
        # Where case is dropped anyway, words that differ in it are one entry.
        self.lower = self._same("A", "a") and self._same("ZQ", "zq")
        self.by_word = all(self._by_word(t) == self._ids(t) for t in _PROBES)
        between = self._ids(SEPARATOR)
        self._between = between[0] if len(between) == 1 else None

    def _ids(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _same(self, a: str, b: str) -> bool:
        return self._ids(a) == self._ids(b)

    def _by_word(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode(), np.uint8)
        words = self.words(data, np.array([0, len(data)]))
        return [i for code in words.codes for i in self._ids(words.vocab[code].as_py().decode())]

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts one after another, and where each text ends among them."""
        if not self.by_word:
            whole = data.tobytes()
            texts = [whole[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            ids = [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
            return np.array([i for x in ids for i in x], np.uint32), ends
        words = self.words(data, offsets)
        if not len(words.codes):
            return np.zeros(0, np.uint32), words.bounds
        known = pa.array(self._codes(words.vocab.to_pylist()), pa.large_binary())
        whole = known.take(pa.array(words.codes))
        ends = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1) // self._kind.itemsize
        ids = whole.buffers()[2]
        flat = np.frombuffer(ids, self._kind, int(ends[-1])) if ends[-1] else np.zeros(0, self._kind)
        return flat.astype(np.uint32), ends[words.bounds]

    def words(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        """Words as units of encoding; special tokens' marks keep case and tails whole."""
        whole = b"<|" in data.tobytes()
        return cut_tails(split(data, offsets, lower=self.lower and not whole), _TAIL)

    def encode(self, vocab: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids one after another."""
        ids = self._codes(vocab)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self._kind.itemsize
        return sizes, np.frombuffer(b"".join(ids), self._kind).astype(np.uint32)

    def _codes(self, vocab: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes."""
        if len(self._known) > CACHED_WORDS:
            self._known, self._older = {}, self._known
        known, older = self._known, self._older
        new = [w for w in vocab if w not in known]
        if older:
            known.update((w, older[w]) for w in new if w in older)
            new = [w for w in new if w not in older]
        known.update(zip(new, self._encoded(new)))
        return list(map(known.__getitem__, vocab))

    def _encoded(self, words: list[bytes]) -> Iterator[bytes]:
        """The ids of new words, encoded as texts of many words and parted at the separators' id.

        Where the separator is no id of its own, or a word holds it, so that their number
        differs, words are encoded one by one.
        """
        joined = JOINED_WORDS if self.by_word and self._between is not None else 1
        parts = [[w.decode() for w in words[at:at + joined]] for at in range(0, len(words), joined)]
        width = self._kind.itemsize
        for part, found in zip(parts, self._batch([f" {SEPARATOR} ".join(p) for p in parts])):
            cuts = np.flatnonzero(found == self._between) if len(part) > 1 else np.zeros(0, np.int64)
            if len(cuts) == len(part) - 1:
                flat = found.tobytes()
                begins, ends = [0, *((cuts + 1) * width).tolist()], [*(cuts * width).tolist(), len(flat)]
                yield from (flat[a:b] for a, b in zip(begins, ends))
            else:
                yield from (ids.tobytes() for ids in self._batch(part))

    def _batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        return (np.array(e.ids, self._kind) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False))


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(documents: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Each document cut into pieces of at most ``window`` ids, with their checksums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        for batch in batches:
            ids = batch.column(0)
            for row, data, offsets in blocks(batch.column(1), BLOCK_BYTES):
                stream, ends = known.texts(data, offsets)
                out: list[tuple[int, int, int, int, int]] = []
                for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                    whole = np.append(stream[a:b], np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(whole), window):
                        piece = whole[at:at + window]
                        out.append((row + i, at, len(piece), zlib.crc32(piece.tobytes()), len(whole)))
                rows, *rest = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), *[pa.array(c, pa.int64()) for c in rest]],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts of lengths, within ``counts``, whose sum comes closest to ``capacity``.

    Bit ``s`` of the set says that some multiset sums to ``s``. Lengths are added
    in binary parts, longest first, until the capacity itself can be reached.
    """
    full, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left > 0 and not reach >> capacity:
            times = min(part, left)
            steps.append((length, times, reach))
            reach |= (reach << (times * length)) & full
            left, part = left - times, part * 2
        if reach >> capacity:
            break
    total, used = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + times
            total -= times * length
    return used


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """``(times, {length: number})`` patterns that use up all rests."""
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        used = best_fill({k: v for k, v in left.items() if v > 0}, window - longest)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
        out.append((times, used))
    return out


def slots(counts: dict[int, int], window: int = WINDOW) -> dict[str, np.ndarray]:
    """For each length, from which rank on its pieces go to which sequences.

    Sorted by ``length`` and ``rank``; ``copies`` pieces go to each sequence.
    """
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, lengths in plan({k: v for k, v in counts.items() if k < window}, window):
        offset = 0
        for length in sorted(lengths, reverse=True):
            rows.append((length, used.get(length, 0), lengths[length], sequence, offset))
            used[length] = used.get(length, 0) + times * lengths[length]
            offset += length * lengths[length]
        sequence += times
    if counts.get(window):
        rows.append((window, 0, 1, sequence, 0))
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "copies", "sequence", "offset"), table.T))


def pack(documents: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``."""
    spark = documents.sparkSession
    # The place in the stored table tells equal pieces apart.
    numbered = pieces(documents, tokenizer, window, end_id).withColumn("_at", F.monotonically_increasing_id())
    cut, _ = keep(numbered, "pieces")
    # Bounded by the window, not by the rows.
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(slots(counts, window))
    buckets = 1 + sum(counts.values()) // BUCKET_ROWS
    dealt = cut.withColumn("_bucket", F.pmod(F.xxhash64("_at"), F.lit(buckets)))
    # A length that many documents share is ranked bucket by bucket, and buckets in groups.
    grouped = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("n")).withColumn("_group", F.floor(F.col("_bucket") / BUCKET_ROWS))
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("length", "_group").agg(F.sum("n").alias("n")).select(
        "length", "_group", F.coalesce(F.sum("n").over(earlier("length", "_group")), F.lit(0)).alias("_base")
    )
    inside = F.coalesce(F.sum("n").over(earlier("length", "_group", "_bucket")), F.lit(0))
    firsts = grouped.withColumn("_inside", inside).join(groups, ["length", "_group"]).select(
        "length", "_bucket", (F.col("_base") + F.col("_inside")).alias("_first")
    )
    order = Window.partitionBy("length", "_bucket").orderBy("_at")
    ranked = dealt.withColumn("_in", F.row_number().over(order) - 1).join(firsts, ["length", "_bucket"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_first") + F.col("_in")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        shift = np.int64(48)
        keys = (table["length"] << shift) + table["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length.astype(np.int64) << shift) + rank, "right") - 1
            nth = rank - table["rank"][at]
            copies = table["copies"][at]
            sequence = table["sequence"][at] + nth // copies
            offset = table["offset"][at] + nth % copies * length
            columns = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
