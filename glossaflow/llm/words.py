"""Words of whole texts, in Arrow arrays: splitting, hashing, windows.

A word is a maximal run of bytes other than space and U+0009 to U+000D. Texts are
worked on in blocks, so a worker's memory is bounded by the block size or by the
longest single text. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
# Odd multipliers of the window hash and of the finaliser (murmur3's).
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(texts: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of runs of rows of about ``limit`` bytes."""
    data, offsets = utf8(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(n, max(row + 1, stop))
        yield row, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
        row = stop


@dataclass
class Words:
    """Words of some texts; ``bounds[i]:bounds[i + 1]`` are those of text ``i``."""

    data: np.ndarray
    inside: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @cached_property
    def _coded(self) -> pa.DictionaryArray:
        at = np.concatenate(([0], np.cumsum(self.ends - self.starts))).astype(np.int64)
        packed = pa.Array.from_buffers(
            pa.large_binary(), len(self.starts), [None, pa.py_buffer(at), pa.py_buffer(self.data[self.inside])]
        )
        return packed.dictionary_encode()

    @cached_property
    def codes(self) -> np.ndarray:
        """Each word's place in ``vocab``."""
        return self._coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    @property
    def vocab(self) -> pa.Array:
        """The distinct words."""
        return self._coded.dictionary

    @property
    def owner(self) -> np.ndarray:
        """Text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of each word: its bytes in groups of eight, and its length."""
        sizes = self.ends - self.starts
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        groups = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        out = mix(sizes.astype(np.uint64) * _STEP + np.uint64(seed))
        left, at, todo = sizes, self.starts, slice(None)
        while len(left):
            value = groups[at] & _LOW_BYTES[np.minimum(left, 8)]
            out[todo] = mix((out[todo] ^ value) * _STEP)
            more = np.flatnonzero(left > 8)
            todo = more if isinstance(todo, slice) else todo[more]
            left, at = left[more] - 8, at[more] + 8
        return out

    def windows(self, size: int) -> np.ndarray:
        """First words of all windows of ``size`` words inside one text."""
        left = np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(len(self.starts))
        return np.flatnonzero(left >= size)


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Split texts, given as bytes and offsets, into words; ``lower`` folds A-Z."""
    # Arithmetic on bytes is several times as fast as a look-up in a table.
    if lower:
        data = data | (((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))
    inside = (data != 32) & ((data - np.uint8(9)) > 4)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    # A word ends before the next white space, text edge or end of the data.
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = edges[edges > 0]
    last[edges - 1] = inside[edges - 1]
    ends = np.flatnonzero(last) + 1
    return Words(data, inside, np.searchsorted(starts, offsets), starts, ends)


def cut_tails(words: Words, tail: np.ndarray) -> Words:
    """Words with their last run of ``tail`` bytes cut off where a letter A-Z stands before it."""
    data = words.data
    firm = np.where(tail[data] | ~words.inside, -1, np.arange(len(data)))
    last = np.maximum.accumulate(firm)[words.ends - 1] if len(words.ends) else words.ends
    cut = np.flatnonzero((last >= words.starts) & (last + 1 < words.ends) & _LETTER[data[np.maximum(last, 0)]])
    at = last[cut] + 1
    starts, ends = np.insert(words.starts, cut + 1, at), np.insert(words.ends, cut, at)
    return Words(data, words.inside, words.bounds + np.searchsorted(cut, words.bounds), starts, ends)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX[0]
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX[1]
    return h ^ (h >> np.uint64(33))


def window_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the ``size`` words from each index in ``first``."""
    total = np.zeros(len(first), np.uint64)
    for j in range(size):
        total = total * _STEP + hashes[first + j]
    return mix(total)


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` inside each pair of neighbouring bounds."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def char_counts(data: np.ndarray, wanted: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes of each text for which the 256-entry table ``wanted`` is set."""
    return per_text(wanted[data].astype(np.int64), offsets)
