"""Set-similarity self-join by prefix filtering (rare tokens first).

Sets are ordered by one global order, rarest token first. Two sets of Jaccard
similarity ``percent`` or more share a token among their first
``n - ceil(percent * n / 100) + 1`` tokens, so only prefix tokens are shuffled.
Candidates of a shared token pass a length filter, a positional filter and a
parity bitmap (tokens that differ flip single bits, so the number of differing
bits bounds the symmetric difference from below), and the rest are verified once.
Sets of many tokens have a bitmap of 128 bits, whose halves fold into the 64 bits
of smaller ones. That says little of sets of hundreds of tokens, so callers may have
:func:`describe` make bitmaps that grow with the sets, a bit or two for each token, and
leave out by :func:`near` the pairs these tell apart before any set is fetched.

Token frequencies come from a sketch of fixed size counted over all rows. It only
decides the order: any fixed order gives the same result, and in a sketch filled by
a large corpus the frequent tokens still stand out and go last.

Postings travel as blocks: the rows of one bucket of tokens, packed by the task that made
them. Spark deals the blocks out by bucket, and a task puts one bucket's rows in order at a
time. The number of buckets grows with the tokens, so a bucket's rows do not.

Tokens shared by many sets ("hot" runs) are not paired all with all: every set is
paired with the run's first set. Neither are groups of near copies inside shorter runs,
whose sets meet the first and the nearest before them. Both leave their sets as hot rows,
and callers ask for the remaining pairs only where a question is still open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH = 1 << 18
# Counts of the sketch in one row.
SLICE = 1 << 12
# Words of 64 bits in the table that tells which keys may have a row.
SIEVE_BITS = 17
# Expected sets of one token in one task; beyond it, the token is salted.
PART_ROWS = 1 << 16
# Buckets of postings: so many at least, and one for so many tokens of all sets.
BUCKETS, BUCKET_TOKENS = 1_024, 1 << 20
# Postings a task holds before it deals them out to buckets, and the most of one block.
HELD_ROWS = 1 << 18
BLOCK_ROWS = 1 << 13
# Runs up to this length give all their pairs.
BULK = 32
# Candidates per set that a longer run makes; groups with more make two for each set.
PARTNERS = 4
# Larger sets get a bitmap of two words.
PARITY_SIZE = 64
# Places for sets that a task remembers to leave out copies; forgetting some only costs rows.
SEEN = 1 << 17
# Pairs that pass the filters in one go, which bounds a worker's memory.
CHECKED_AT_ONCE = 1 << 15
# Pairs that the sizes allow, of as many runs as are compared together.
COMPARED_AT_ONCE = 1 << 18
# Pairs that are verified in one go; their numbers fit 16 bits.
PAIRS_AT_ONCE = 2_048

#: What an extractor yields per block of a batch: row of each set in the batch, its
#: ordinal in the row, bounds, and its distinct tokens in ascending order.
Sets = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
Extractor = Callable[[pa.Array], Iterator[Sets]]

MADE = "kind int, doc long, line int, n int, e long, h long, counts binary, bits binary"
SLICES = "doc long, counts binary"
POSTING = "token long, part int, doc long, line int, e long, n int, pos int, sig long, more long, before long"
FOUND = "kind int, token long, a long, b long, doc long, line int, n int, pos int, sig long, more long"
PAIR, HOT, ANCHOR = 0, 1, 2
BLOCK = "bucket int, postings binary"
# A posting as it stands in a block.
RECORD = np.dtype([(f.split(" ")[0], "<i4" if f.endswith(" int") else "<i8") for f in POSTING.split(", ")])


def bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(46)).astype(np.int64)


def set_hashes(bounds: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """64-bit identity of each set."""
    spread = (tokens ^ (tokens >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    spread ^= spread >> np.uint64(32)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)))
    sums = total[bounds[1:]] - total[bounds[:-1]]
    return (sums ^ (np.diff(bounds).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)


def _ascending(owner: np.ndarray, tokens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``owner`` and ``tokens`` in ascending order of both.

    One sort by a single number: the owner and the token's upper bits. Where tokens
    of one owner differ in the lower bits only, both are sorted one after the other.
    """
    low = np.uint64(max(n - 1, 1).bit_length())
    order = np.argsort((owner.astype(np.uint64) << (np.uint64(64) - low)) | (tokens >> low))
    first, then = owner[order], tokens[order]
    if ((first[1:] == first[:-1]) & (then[1:] < then[:-1])).any():
        order = np.lexsort((tokens, owner))
        first, then = owner[order], tokens[order]
    return first, then


def _by_rarity(owner: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Stable order by owner and rarity (16 bits): a sort of numbers that hold all three, where they fit."""
    at = max(len(owner) - 1, 1).bit_length()
    if int(owner.max(initial=0)).bit_length() + 16 + at > 64:
        return np.lexsort((rarity, owner))
    key = (owner.astype(np.uint64) << np.uint64(16)) | rarity
    key = np.sort((key << np.uint64(at)) | np.arange(len(owner), dtype=np.uint64))
    return (key & np.uint64((1 << at) - 1)).astype(np.int64)


def unique_sets(owner: np.ndarray, tokens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bounds, tokens)``: distinct tokens of ``n`` owners, ascending."""
    owner, tokens = _ascending(owner, tokens, n)
    fresh = np.ones(len(tokens), dtype=bool)
    fresh[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    owner, tokens = owner[fresh], tokens[fresh]
    return np.searchsorted(owner, np.arange(n + 1)), tokens


def _batch(schema: str, rows: int, /, **columns) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, arrays = [], []
    for field in schema.split(", "):
        name, kind = field.split(" ")
        values = columns.get(name, 0)
        names.append(name)
        if isinstance(values, pa.Array):
            arrays.append(values)
        elif kind == "binary":
            arrays.append(pa.array(values, kinds[kind]) if name in columns else pa.nulls(rows, kinds[kind]))
        else:
            arrays.append(pa.array(np.broadcast_to(values, rows), kinds[kind]))
    return pa.RecordBatch.from_arrays(arrays, names)


def _taken(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """``rows[order]``; numpy copies plain numbers faster than records."""
    return rows.view(np.int64).reshape(len(rows), -1).take(order, axis=0).reshape(-1).view(RECORD)


def _blocks(held: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """The postings held as blocks, in batches of bounded size; ``held`` is empty afterwards."""
    rows = np.concatenate(held)
    held.clear()
    spread = (rows["token"].view(np.uint64) ^ rows["part"].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    at = ((spread >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(at, kind="stable")
    at, rows = at[order], _taken(rows, order)
    fresh = np.flatnonzero(at[1:] != at[:-1]) + 1
    cuts = np.union1d(fresh, np.arange(0, len(rows), BLOCK_ROWS))
    offsets = np.append(cuts, len(rows)) * RECORD.itemsize
    packed = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(rows)])
    whole = pa.RecordBatch.from_arrays([pa.array(at[cuts]), packed], ["bucket", "postings"])
    ends = np.append(np.searchsorted(cuts, np.arange(0, len(rows), 4 * BLOCK_ROWS)), len(cuts))
    for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
        yield whole.slice(begin, end - begin)


def _unpacked(blocks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Postings of a column of blocks, and where each block's begin and end."""
    blocks = blocks.cast(pa.large_binary())
    offsets = np.frombuffer(blocks.buffers()[1], np.int64, len(blocks) + 1, 8 * blocks.offset)
    rows = np.frombuffer(blocks.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].view(RECORD)
    return rows, (offsets - offsets[0]) // RECORD.itemsize


def packed(rows: DataFrame) -> DataFrame:
    """Plain postings as blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = np.empty(batch.num_rows, RECORD)
                for c in RECORD.names:
                    own[c] = batch.column(c).to_numpy()
                yield from _blocks([own], BUCKETS)

    return rows.select(*RECORD.names).mapInArrow(run, BLOCK)


def bitmaps(bounds: np.ndarray, tokens: np.ndarray) -> pa.Array:
    """Parity bitmaps of sets of more than ``PARITY_SIZE`` tokens, null for others.

    A set has as many bits as it has tokens, rounded up to a power of two.
    """
    size = np.diff(bounds)
    some = size > PARITY_SIZE
    width = np.where(some, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), 0)
    begins = np.cumsum(width) - width
    at = np.repeat(some, size)
    place = np.repeat(begins, size)[at] + (tokens[at] & np.repeat(width - 1, size)[at].view(np.uint64)).astype(np.int64)
    data = np.packbits(np.bincount(place, minlength=int(width.sum())).astype(np.uint8) & 1, bitorder="little")
    offsets = (np.append(begins, width.sum()) // 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [pa.py_buffer(np.packbits(some, bitorder="little")), pa.py_buffer(offsets), pa.py_buffer(data)])


def bitmaps_allow(s: pa.Array, t: pa.Array, m: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets of ``m`` and ``n`` tokens may be similar by their bitmaps; a null one allows it."""
    (x, x_at), (y, y_at) = _bytes(s), _bytes(t)
    most = m + n - 2 * -(-percent * (m + n) // (100 + percent))
    long, wide = np.diff(x_at), np.diff(y_at)
    ok = np.ones(len(m), dtype=bool)
    for k, w in sorted({(k, w) for k, w in zip(long.tolist(), wide.tolist()) if k and w}):
        own, low = np.flatnonzero((long == k) & (wide == w)), min(k, w)
        # Of two sizes, the longer bitmap folds into the bits of the shorter one.
        first = np.bitwise_xor.reduce(x[x_at[own][:, None] + np.arange(k)].reshape(len(own), -1, low), axis=1)
        second = np.bitwise_xor.reduce(y[y_at[own][:, None] + np.arange(w)].reshape(len(own), -1, low), axis=1)
        ok[own] = np.bitwise_count((first ^ second).view(np.uint64)).sum(axis=1, dtype=np.int64) <= most[own]
    return ok


def near(pairs: DataFrame, made: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that the sets' bitmaps in ``made`` do not tell apart.

    No similar pair is lost: bitmaps differ in no more bits than sets do in tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.ones(batch.num_rows, dtype=bool)
            for at in range(0, batch.num_rows, PAIRS_AT_ONCE):
                part = batch.slice(at, PAIRS_AT_ONCE)
                m, n = (part.column(c).to_numpy().astype(np.int64) for c in ("m", "n"))
                ok[at:at + part.num_rows] = bitmaps_allow(part.column("s"), part.column("t"), m, n, percent)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    ends = pairs.select(F.col("a").alias("e")).union(pairs.select("b"))
    large = made.filter(f"kind = 0 AND n > {PARITY_SIZE}").select("e", "n", "bits")
    bits = sieved(large, ends, "e").dropDuplicates(["e"])
    left = bits.select(F.col("e").alias("a"), F.col("n").alias("m"), F.col("bits").alias("s"))
    right = bits.select(F.col("e").alias("b"), "n", F.col("bits").alias("t"))
    # Small sets have no bitmap, and their pairs pass.
    both = pairs.select("a", "b").join(left, "a", "left").join(right, "b", "left").fillna(0, ["m", "n"])
    return both.select("a", "b", "m", "n", "s", "t").mapInArrow(run, "a long, b long")


def describe(documents: DataFrame, extract: Extractor, with_bitmaps: bool = False) -> DataFrame:
    """Sets as rows of ``kind`` 0; token counts of each task as ``kind`` 1.

    ``h`` is the hash of the whole text (:func:`text_hash`), which tells rows of one id
    apart. A count row holds a slice of the task's sketch in ``counts`` and its number in ``doc``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        for batch in batches:
            ids, texts = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            for rows, line, bounds, tokens in extract(batch.column(1)):
                counts += np.bincount(bucket(tokens), minlength=SKETCH)
                own = {"bits": bitmaps(bounds, tokens)} if with_bitmaps else {}
                yield _batch(MADE, len(rows), doc=ids[rows], line=line, n=np.diff(bounds), e=set_hashes(bounds, tokens), h=texts[rows], **own)
        slices = counts.reshape(-1, SLICE)
        some = np.flatnonzero(slices.any(axis=1))
        yield _batch(MADE, len(some), kind=1, doc=some, counts=[slices[k].tobytes() for k in some])

    known = documents.filter(F.col("doc_id").isNotNull())
    return known.select(F.col("doc_id").cast("long"), "text", text_hash(F.col("text"))).mapInArrow(run, MADE)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sieved(rows: DataFrame, wanted: DataFrame, *on: str) -> DataFrame:
    """``rows`` without most of those whose key ``on`` is not in ``wanted``, before they are shuffled.

    One hash of the key marks a bit in a table of fixed size, whatever the input; a key
    that shares its bit with a wanted one stays, so an exact join has to follow.
    """
    key = F.xxhash64(*on)
    word, bit = F.shiftrightunsigned(key, 64 - SIEVE_BITS), key.bitwiseAND(F.lit(63)).cast("int")
    marks = wanted.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_mark"))
    table = F.broadcast(marks.groupBy("_word").agg(F.bit_or("_mark").alias("_marks")))
    return rows.join(table, (word == F.col("_word")) & (F.getbit("_marks", bit) == 1), "left_semi")


def frequencies(made: DataFrame) -> np.ndarray:
    """Token counts of all rows; ``SKETCH`` numbers whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, some in zip(batch.column("doc").to_pylist(), batch.column("counts").to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(some, np.int64)
        yield _batch(SLICES, len(sums), doc=np.array(list(sums), np.int64), counts=[x.tobytes() for x in sums.values()])

    sums = made.filter("kind = 1").select("doc", "counts").repartition("doc").mapInArrow(run, SLICES)
    counts = np.zeros((SKETCH // SLICE, SLICE), np.int64)
    for row in sums.collect():
        counts[row["doc"]] = np.frombuffer(row["counts"], np.int64)
    return counts.reshape(-1)


def postings(documents: DataFrame, extract: Extractor, counts: np.ndarray, percent: int) -> DataFrame:
    """Prefix tokens of each distinct set, in blocks; copies met by one task count once."""
    buckets = max(BUCKETS, int(counts.sum()) // BUCKET_TOKENS)
    shared = documents.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        level = np.minimum(np.log2(counts + 1) * 1_000, 65_000).astype(np.uint16)
        mean = counts.mean()
        parts = 1 + np.maximum(0, counts - mean - 4 * np.sqrt(mean)).astype(np.int64) // PART_ROWS
        # Each set has one place. At first these hold numbers whose place is another one.
        seen = np.arange(1, SEEN + 1)
        first = np.zeros(SEEN, np.int64)
        held, n_held = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, line, bounds, tokens in extract(batch.column(1)):
                e = set_hashes(bounds, tokens)
                place, own = e & (SEEN - 1), np.arange(len(e))
                # Of copies the first stands for all: its place tells what is earlier.
                first[place[::-1]] = own[::-1]
                new = (seen[place] != e) & ((first[place] == own) | (e[first[place]] != e))
                seen[place] = e
                size = np.diff(bounds)
                owner = np.repeat(np.arange(len(e)), size)
                owner, tokens = owner[new[owner]], tokens[new[owner]]
                bits = np.uint64(1) << (tokens & np.uint64(63))
                sig, more = np.zeros(len(e), np.uint64), np.zeros(len(e), np.uint64)
                some = np.flatnonzero(new & (size > 0))
                if not len(some):
                    continue
                starts = np.searchsorted(owner, some)
                second = (size[owner] > PARITY_SIZE) & ((tokens >> np.uint64(6)) & np.uint64(1) > 0)
                sig[some] = np.bitwise_xor.reduceat(np.where(second, np.uint64(0), bits), starts)
                more[some] = np.bitwise_xor.reduceat(np.where(second, bits, np.uint64(0)), starts)
                order = _by_rarity(owner, level[bucket(tokens)])
                owner, tokens = owner[order], tokens[order]
                pos = np.arange(len(owner)) - np.repeat(starts, size[some])
                before = np.zeros(len(owner), np.uint64)
                before[1:] = tokens[:-1]
                before[pos == 0] = e[owner[pos == 0]].view(np.uint64)
                short = pos <= size[owner] + (-percent * size[owner]) // 100
                owner, tokens, pos, before = owner[short], tokens[short], pos[short], before[short]
                # Part 0 holds all sets of a token; parts from 1 on share one.
                share = parts[bucket(tokens)].astype(np.uint64)
                part = np.where(share > 1, 1 + e[owner].view(np.uint64) % share, 0)
                made = np.empty(len(owner), RECORD)
                for c, values in (
                    ("token", tokens.view(np.int64)), ("part", part), ("doc", ids[rows[owner]]), ("line", line[owner]),
                    ("e", e[owner]), ("n", size[owner]), ("pos", pos), ("sig", sig.view(np.int64)[owner]),
                    ("more", more.view(np.int64)[owner]), ("before", before.view(np.int64)),
                ):
                    made[c] = values
                held.append(made)
                n_held += len(made)
                if n_held >= HELD_ROWS:
                    yield from _blocks(held, buckets)
                    n_held = 0
        if held:
            yield from _blocks(held, buckets)

    known = documents.filter(F.col("doc_id").isNotNull())
    return known.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BLOCK)


def passes(percent: int, n1, n2, p1, p2, s1, s2, m1, m2) -> tuple[np.ndarray, np.ndarray]:
    """Length, positional and parity filters of candidates at one shared token, and bits apart.

    The positional filter takes the token as the pair's first common one, so all
    overlap lies from here on. A similar pair passes at the token where that is so.
    """
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    need = -(-percent * (n1 + n2) // (100 + percent))
    most = np.minimum(n1 - p1, n2 - p2)
    count = lambda x: np.bitwise_count(x.view(np.uint64)).astype(np.int64)
    first, second = s1 ^ s2, m1 ^ m2
    apart = np.where(small > PARITY_SIZE, count(first) + count(second), count(first ^ second))
    return (100 * small >= percent * large) & (most >= need) & (apart <= n1 + n2 - 2 * need), apart


def passes_sql(percent: int, a: str, b: str) -> Column:
    """:func:`passes` as a join condition."""
    n1, n2, p1, p2 = (F.col(f"{t}.{c}").cast("long") for c in ("n", "pos") for t in (a, b))
    need = F.ceil(percent * (n1 + n2) / F.lit(100.0 + percent) - 1e-9)
    most = F.least(n1 - p1, n2 - p2)
    near = bits_apart(a, b) <= n1 + n2 - 2 * need
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (most >= need) & near


def bits_apart(a: str, b: str) -> Column:
    """Bits in which the bitmaps of two sets differ."""
    first, second = (F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")) for c in ("sig", "more"))
    both = F.bit_count(first) + F.bit_count(second)
    return F.when(F.least(f"{a}.n", f"{b}.n") > PARITY_SIZE, both).otherwise(F.bit_count(first.bitwiseXOR(second)))


def candidates(rows: DataFrame, percent: int, cold: int) -> DataFrame:
    """Pairs of sets that share a token, hot postings, and anchors of salted runs.

    Pairs hold the bits apart in ``n``.

    ``rows`` are blocks, or plain postings. Up to ``cold`` sets of one token are compared
    all with all, which the filters make cheap. Only the bucket at hand is held.
    """

    def passing(x, all_i, all_j) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = [(all_i[:0], all_j[:0], all_i[:0])]
        for at in range(0, len(all_i), CHECKED_AT_ONCE):
            i, j = all_i[at:at + CHECKED_AT_ONCE], all_j[at:at + CHECKED_AT_ONCE]
            # A pair that shares the token before as well is met there.
            fresh = (x["e"][i] != x["e"][j]) & (x["before"][i] != x["before"][j])
            i, j = i[fresh], j[fresh]
            ok, apart = passes(percent, *[x[c][k] for c in ("n", "pos", "sig", "more") for k in (i, j)])
            out.append((i[ok], j[ok], apart[ok]))
        return tuple(map(np.concatenate, zip(*out)))

    def made(x, i, j, apart) -> pa.RecordBatch:
        a, b = x["e"][i], x["e"][j]
        return _batch(FOUND, len(a), kind=PAIR, a=np.minimum(a, b), b=np.maximum(a, b), n=apart)

    def pairs(x, i, j) -> pa.RecordBatch:
        return made(x, *passing(x, i, j))

    def compared(x, sizes) -> Iterator[pa.RecordBatch]:
        """Pairs of runs of the given sizes, which stand one behind the other."""
        n, number = x["n"], np.repeat(np.arange(len(sizes)), sizes)
        # The largest partner the tokens from here on allow: a set that keeps this
        # overlap with it may not be larger (length and positional filter in one).
        most = (100 + percent) * (n - x["pos"]) // percent - n
        # In order of size the partners of a set that are no smaller stand side by side.
        by_size = np.lexsort((n, number))
        width = int(n.max(initial=0)) + 2
        keys = number * width + n[by_size]
        partners = np.searchsorted(keys, number * width + np.clip(most[by_size], 0, width - 1), "right") - np.arange(1, len(n) + 1)
        partners = np.maximum(partners, 0)
        per_run = np.bincount(number, partners, len(sizes)).astype(np.int64)
        # As many runs at a time as make a bounded number of pairs, one at least.
        step = (np.cumsum(per_run) - per_run) // COMPARED_AT_ONCE
        bounds = np.searchsorted(step[number], np.unique(step), "left")
        for begin, end in zip(bounds.tolist(), [*bounds[1:].tolist(), len(n)]):
            count = partners[begin:end]
            first = np.repeat(np.arange(begin, end), count)
            then = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
            i, j = by_size[first], by_size[then]
            ok = n[i] <= most[j]
            i, j = i[ok], j[ok]
            i, j, apart = passing(x, np.minimum(i, j), np.maximum(i, j))
            # Most runs make none, and a batch without rows costs as much as one of many.
            if not len(i):
                continue
            full = np.bincount(number[i], minlength=len(sizes)) > PARTNERS * sizes
            crowded = (full & (sizes > BULK))[number[i]]
            if crowded.any():
                left, i, j, apart = (i[crowded], j[crowded], apart[crowded]), i[~crowded], j[~crowded], apart[~crowded]
                yield from crowd(x, *left)
            if len(i):
                yield made(x, i, j, apart)

    def crowd(x, i, j, apart) -> Iterator[pa.RecordBatch]:
        """Of sets with many partners the pairs with the first and the nearest before them.

        Near copies share all their tokens and would make all pairs of their group. What
        is left out here can be had from the hot rows of the sets it concerns.
        """
        chosen = np.zeros(len(i), dtype=bool)
        for order in (np.lexsort((i, j)), np.lexsort((i, apart, j))):
            own = j[order]
            chosen[order[np.append(True, own[1:] != own[:-1])]] = True
        yield hot(x, HOT, np.union1d(i[~chosen], j[~chosen]))
        yield made(x, i[chosen], j[chosen], apart[chosen])

    def hot(x, kind, at) -> pa.RecordBatch:
        return _batch(FOUND, len(at), kind=kind, a=x["e"][at], **{c: x[c][at] for c in ("token", "doc", "line", "n", "pos", "sig", "more")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("bucket").to_numpy()
            rows, bounds = _unpacked(batch.column("postings"))
            fresh = np.flatnonzero(own[1:] != own[:-1]) + 1
            for begin, end in zip([0, *fresh.tolist()], [*fresh.tolist(), len(own)]):
                if held and own[begin] != now:
                    yield from one_bucket(np.concatenate(held))
                    held = []
                now = own[begin]
                held.append(rows[bounds[begin]:bounds[end]])
        if held:
            yield from one_bucket(np.concatenate(held))

    def edges(token, part) -> np.ndarray:
        edge = np.ones(len(token), dtype=bool)
        edge[1:] = (token[1:] != token[:-1]) | (part[1:] != part[:-1])
        return edge

    def one_bucket(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """What the runs of a bucket make; long ones are in order of their documents and lines."""
        token, part = (np.ascontiguousarray(rows[c]) for c in ("token", "part"))
        order = np.lexsort((part, token)) if part.any() else np.argsort(token)
        token, part = token[order], part[order]
        edge = edges(token, part)
        # A set that meets no other makes nothing, unless other parts of its token do.
        alone = edge & np.append(edge[1:], True) & (part == 0)
        order, edge = order[~alone], edge[~alone]
        if not len(order):
            return
        begins = np.flatnonzero(edge)
        sizes = np.diff(np.append(begins, len(order)))
        at = np.flatnonzero(np.repeat(sizes > min(cold, BULK), sizes) | (part[~alone] > 0))
        if len(at):
            some, number = rows[order[at]], np.cumsum(edge)[at]
            order[at] = order[at[np.lexsort((some["line"], some["doc"], number))]]
        rows = _taken(rows, order)
        yield from whole({c: rows[c].astype(np.int64) for c in RECORD.names}, begins, len(order))

    def whole(x, begins, n) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(np.append(begins, n))
        salted = x["part"][begins] > 0
        small = (sizes > 1) & (sizes <= cold) & ~salted
        at = np.flatnonzero(np.repeat(small, sizes))
        yield from compared({c: v[at] for c, v in x.items()}, sizes[small])
        many = (sizes > cold) | salted
        if many.any():
            at = np.flatnonzero(np.repeat(many, sizes))
            start = np.repeat(begins[many], sizes[many])
            yield pairs(x, start, at)
            yield hot(x, HOT, at)
            yield hot(x, ANCHOR, begins[many])

    blocks = rows if "bucket" in rows.columns else packed(rows)
    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, FOUND)


def anchor_pairs(found: DataFrame, percent: int, cold: int) -> DataFrame:
    """Pairs of the first sets of a salted token's parts."""
    split = found.filter(f"kind = {ANCHOR}")
    salted = split.groupBy("token").agg(F.count("*").alias("_parts")).filter("_parts > 1")
    rows = split.join(salted, "token").select("token", F.lit(0).alias("part"), "doc", "line", F.col("a").alias("e"), "n", "pos", "sig", "more", F.col("a").alias("before"))
    return candidates(rows, percent, cold).filter(f"kind = {PAIR}").select("a", "b", "n")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that are similar, as ``(x, y)`` of the sets' ``id``.

    ``sets`` holds ``e``, ``id`` and ``tokens`` (ascending 64-bit integers as
    bytes). A suffix filter compares how many tokens of the two sets fall between
    a few pivots before the overlap is counted, for a batch of pairs at a time.
    """
    left = sets.select(F.col("e").alias("a"), F.col("id").alias("x"), F.col("tokens").alias("s"))
    right = sets.select(F.col("e").alias("b"), F.col("id").alias("y"), F.col("tokens").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, dtype=bool)
            for at in range(0, batch.num_rows, PAIRS_AT_ONCE):
                part = batch.slice(at, PAIRS_AT_ONCE)
                ok[at:at + part.num_rows] = similar_pairs(part.column("s"), part.column("t"), percent)
            yield batch.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("x", "y", "s", "t")
    return joined.mapInArrow(run, "x long, y long")


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that a binary column lies in, and where each value's begin and end."""
    column = column.cast(pa.large_binary())
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole, np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)


def _flat(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a column of sets, and the size of each set."""
    whole, offsets = _bytes(sets)
    return np.frombuffer(whole[offsets[0]:offsets[-1]].tobytes(), np.uint64), np.diff(offsets) // 8


def similar_pairs(s: pa.Array, t: pa.Array, percent: int) -> np.ndarray:
    """Which sets of ``s`` are similar to those of ``t`` at the same places."""
    (a, m), (b, n) = _flat(s), _flat(t)
    need = -(-percent * (m + n) // (100 + percent))
    left, right = np.repeat(np.arange(len(m)), m), np.repeat(np.arange(len(n)), n)
    # Suffix filter: tokens of both sets in each eighth of the range of hashes.
    eighths = lambda owner, x: np.bincount(owner * 8 + (x >> np.uint64(61)).astype(np.int64), minlength=8 * len(m)).reshape(-1, 8)
    apart = np.abs(eighths(left, a) - eighths(right, b)).sum(axis=1)
    maybe = apart <= m + n - 2 * need
    a, left, b, right = a[maybe[left]], left[maybe[left]], b[maybe[right]], right[maybe[right]]
    tokens = np.concatenate((a, b))
    # Tokens of a pair in ascending order: a token of both sets stands there twice.
    order = np.argsort(tokens, kind="stable")
    owner = np.concatenate((left, right))[order]
    by_pair = np.argsort(owner.astype(np.uint16), kind="stable")
    owner, tokens = owner[by_pair], tokens[order][by_pair]
    twice = (owner[1:] == owner[:-1]) & (tokens[1:] == tokens[:-1])
    return maybe & (np.bincount(owner[1:][twice], minlength=len(m)) >= need) & (need > 0)
