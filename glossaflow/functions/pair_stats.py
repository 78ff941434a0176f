"""Clipped match counts of a prediction against its reference, row by row.

Counting n-grams or tokens with explode + group-by shuffles every one of them.
The counts of a row depend on that row only, so these Arrow functions keep the
work row-local: two texts go in, one small struct of integers comes out, and
corpus figures are plain sums of those.

Rows are handled in blocks. Each gram or token becomes one integer whose high
part is its row and whose lowest bit is its side; after sorting, equal grams of
a row's two sides are neighbours.
"""

from __future__ import annotations

from string import ascii_letters, digits

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from glossaflow.patterns import CHRF_ORDER, IDEOGRAPH_RANGES, WS_RANGES

# Text handled at once. Bounds worker memory whatever the Arrow batch holds; a
# longer text makes its block that much longer.
BLOCK_BYTES = 1 << 16

_IS_SPACE = np.zeros(0x3002, dtype=bool)
for _lo, _hi in WS_RANGES:
    _IS_SPACE[_lo : _hi + 1] = True

# Per code point: 1-62 for an ASCII letter or digit, 63 for an ideograph, else 0.
_IDEOGRAPH = 63
_KIND = np.zeros(0x10001, dtype=np.uint8)
_KIND[[ord(c) for c in ascii_letters + digits]] = np.arange(1, 63)
for _lo, _hi in IDEOGRAPH_RANGES:
    _KIND[_lo : _hi + 1] = _IDEOGRAPH
# Letters that fit one integer, at six bits each.
_PACKED = 10
TOKEN_FIELDS = ["pred_tokens", "ref_tokens", "matched"]


def _matches(keys: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """Clipped matches per row of ``2 * key + side`` integers (sorted in place).

    ``per_row`` holds the number of keys of each row; rows ascend with the keys.
    """
    if not len(keys):
        return np.zeros(len(per_row), dtype=np.int64)
    keys.sort()
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(starts, append=len(keys))
    distinct = keys[starts]
    both = np.flatnonzero((distinct[1:] ^ distinct[:-1]) == 1)
    row = np.repeat(np.arange(len(per_row)), per_row)[starts[both]]
    clipped = np.minimum(counts[both], counts[both + 1])
    return np.bincount(row, weights=clipped, minlength=len(per_row)).astype(np.int64)


def _flatten(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The joined text, its code points, and the text each point belongs to."""
    text = "".join(texts)
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return text, points, np.repeat(np.arange(len(texts), dtype=np.int32), sizes)


def _ngram_block(hyps: list[str], refs: list[str], order: int) -> np.ndarray:
    """Counts of shape (3, order, rows): hypothesis, reference, clipped match."""
    rows = len(hyps)
    _, points, owner = _flatten(hyps + refs)
    keep = ~_IS_SPACE[np.minimum(points, len(_IS_SPACE) - 1)]
    points, owner = points[keep], owner[keep]
    out = np.zeros((3, order, rows), dtype=np.int64)
    if not len(points):
        return out

    lengths = np.bincount(owner, minlength=2 * rows)
    seen = np.zeros(int(points.max()) + 1, dtype=np.int32)
    seen[points] = 1
    alphabet = int(seen.sum())
    side = owner >= rows
    symbol = (np.cumsum(seen) - 1)[points] * 2 + side
    key = (owner - rows * side).astype(np.int64) * (2 * alphabet) + symbol
    bound = 2 * rows * alphabet
    for n in range(1, order + 1):
        totals = np.maximum(lengths - (n - 1), 0)
        out[0, n - 1], out[1, n - 1] = totals[:rows], totals[rows:]
        if n > 1:
            if bound * alphabet >= 1 << 62:
                values, rank = np.unique(key >> 1, return_inverse=True)
                key, bound = rank * 2, 2 * len(values)
            key = (key[:-1] & -2) * alphabet + symbol[n - 1 :]
            bound *= alphabet
        if not len(key):
            break
        whole = owner[: len(key)] == owner[n - 1 :]
        out[2, n - 1] = _matches(key[whole], totals[:rows] + totals[rows:])
    return out


def _token_block(hyps: list[str], refs: list[str]) -> np.ndarray:
    """Counts of shape (3, rows): hypothesis, reference, clipped match.

    Each token becomes an integer: an ideograph its negated code point, a short
    word its packed letters, a longer word its place in a dictionary.
    """
    rows = len(hyps)
    text, points, owner = _flatten(hyps + refs)
    out = np.zeros((3, rows), dtype=np.int64)
    kind = _KIND[np.minimum(points, len(_KIND) - 1)]
    token = kind > 0
    word = token & (kind < _IDEOGRAPH)
    joined = word[1:] & word[:-1] & (owner[1:] == owner[:-1])
    starts = np.flatnonzero(token & ~np.concatenate(([False], joined))[: len(token)])
    if not len(starts):
        return out
    ends = np.flatnonzero(token & ~np.concatenate((joined, [False]))) + 1
    sizes = ends - starts

    code = np.where(word[starts], kind[starts], -points[starts].astype(np.int64))
    for k in range(1, min(int(sizes.max()), _PACKED)):
        more = np.flatnonzero(sizes > k)
        code[more] = code[more] * 64 + kind[starts[more] + k]
    long = np.flatnonzero(sizes > _PACKED)
    if len(long):
        words = pa.array([text[a:b] for a, b in zip(starts[long], ends[long])], pa.string())
        code[long] = np.int64(1 << 60) + words.dictionary_encode().indices.to_numpy()
    tokens = pa.array(code).dictionary_encode()

    owner = owner[starts]
    per_text = np.bincount(owner, minlength=2 * rows)
    out[0], out[1] = per_text[:rows], per_text[rows:]
    side = owner >= rows
    key = (owner - rows * side).astype(np.int64) * len(tokens.dictionary)
    out[2] = _matches((key + tokens.indices.to_numpy()) * 2 + side, out[0] + out[1])
    return out


def _blocks(h: pa.Array, r: pa.Array):
    """Row ranges of about ``BLOCK_BYTES`` of text."""
    sizes = [pc.fill_null(pc.binary_length(x), 0).to_numpy() for x in (h, r)]
    filled = np.cumsum(sizes[0] + sizes[1], dtype=np.int64) // BLOCK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(filled)) + 1).tolist(), len(h)]
    return zip(cuts[:-1], cuts[1:])


def _texts(column: pa.Array, begin: int, end: int) -> list[str]:
    return [t or "" for t in column.slice(begin, end - begin).to_pylist()]


def stat_names(order: int = CHRF_ORDER) -> list[str]:
    """n-gram fields: h1.. hypothesis, r1.. reference, m1.. clipped match."""
    return [f"{kind}{n}" for kind in "hrm" for n in range(1, order + 1)]


def pair_stats(
    hyp: Column, ref: Column, order: int = CHRF_ORDER, tokens: bool = True
) -> Column:
    """Struct of match counts of two texts, in one trip to Python.

    It holds :func:`stat_names` up to ``order``, over characters without white
    space, and with ``tokens`` also ``TOKEN_FIELDS``. Null texts count as empty.
    """
    names = stat_names(order) + (TOKEN_FIELDS if tokens else [])

    def block(hyps: list[str], refs: list[str]) -> np.ndarray:
        parts = []
        if order:
            parts.append(_ngram_block(hyps, refs, order).reshape(3 * order, -1))
        if tokens:
            parts.append(_token_block(hyps, refs))
        return np.concatenate(parts)

    def count(h: pa.Array, r: pa.Array) -> pa.Array:
        parts = [np.zeros((len(names), 0), dtype=np.int64)]
        for a, b in _blocks(h, r):
            parts.append(block(_texts(h, a, b), _texts(r, a, b)))
        columns = np.concatenate(parts, axis=1)
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=names)

    count.__annotations__ = {"h": pa.Array, "r": pa.Array, "return": pa.Array}
    schema = ",".join(f"{name}:bigint" for name in names)
    # Declared nondeterministic so that a filter on the counts is not pushed below
    # them, which would make Spark count twice.
    udf = F.arrow_udf(count, returnType=f"struct<{schema}>").asNondeterministic()
    return udf(hyp, ref)
