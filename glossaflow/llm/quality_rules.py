"""Quality rules: plain counts of a text, and an n-gram logistic regression.

The regression sees hashed word one- and two-grams and character three- and
four-grams. Each group adds the mean weight of its n-grams, so a text is scored in
one pass over its positions, whatever its length. It is fitted on a bounded sample
of labelled rows, its probability is calibrated on rows kept back, and scored against
a fixed threshold after the fixed rules on counts.

Defined results: null text counts as empty; texts of fewer than 50 words fail;
without labelled rows of both classes the regression says 0.5 (or the class seen).
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaflow.llm.calibration import platt
from glossaflow.llm.labelled import one_text_each, sample_of
from glossaflow.llm.quality_fm import is_held_out
from glossaflow.llm.tables import writing
from glossaflow.llm.words import Words, blocks, char_counts, per_text, split

SAMPLE_ROWS = 4_096
THRESHOLD = 0.3
LEAST_WORDS, MOST_REPEATED = 50, 50
BITS = 17
WORD_GRAMS, CHAR_GRAMS = (1, 2), (3, 4)
GROUPS = len(WORD_GRAMS) + len(CHAR_GRAMS)
EPOCHS, LEAST_STEPS, BATCH_ROWS, RATE, DECAY = 8, 500, 64, 0.5, 1e-5

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_LEAD = np.ones(256, dtype=bool)
_LEAD[0x80:0xC0] = False
_STEP = np.uint64(0x9E3779B97F4A7C15)

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in STATS) + ", base_failed boolean, score double, kept boolean"


def _repeated_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line."""
    whole, out = data.tobytes(), np.zeros(len(offsets) - 1, np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        lines = [x for x in whole[a:b].split(b"\n") if x.strip()]
        out[i] = len(lines) - len(set(lines))
    return out


def _repeated_words(words: Words, size: int = 3) -> np.ndarray:
    """Words per text that lie in a window of ``size`` words found twice in it."""
    first = words.windows(size)
    mark = np.zeros(len(words.starts), dtype=bool)
    if len(first):
        key = words.codes[first]
        for j in range(1, size):
            if key.max() >= (1 << 62) // len(words.vocab):
                key = np.unique(key, return_inverse=True)[1]
            key = key * len(words.vocab) + words.codes[first + j]
        owner = words.owner[first]
        order = np.argsort(key, kind="stable")
        order = order[np.argsort(owner[order].astype(np.uint32), kind="stable")]
        same = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        twice = np.zeros(len(first), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for j in range(size):
            mark[first[twice] + j] = True
    return per_text(mark.astype(np.int64), words.bounds)


def base_counts(data: np.ndarray, offsets: np.ndarray, words: Words) -> dict[str, np.ndarray]:
    inside = (words.inside & _LEAD[data]).astype(np.int64)
    return {
        "n_words": np.diff(words.bounds), "word_chars": per_text(inside, offsets),
        "n_symbols": char_counts(data, SYMBOLS, offsets),
        "n_dup_lines": _repeated_lines(data, offsets), "n_repeat_words": _repeated_words(words),
    }


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])


def _slots(items: np.ndarray, size: int, group: int) -> np.ndarray:
    """Weight numbers of the n-grams from each item on."""
    n = max(0, len(items) - size + 1)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = (h + items[j:j + n]) * _STEP
        h ^= h >> np.uint64(31)
    return (group << BITS) + ((h * _STEP) >> np.uint64(64 - BITS)).astype(np.int64)


def grams(data: np.ndarray, offsets: np.ndarray, words: Words) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per group: weight numbers by position, and each text's first and last position."""
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.uint64)
    chars = np.concatenate(([0], np.cumsum(_LEAD[data], dtype=np.int64)))[offsets]
    out = []
    for group, (size, items, bounds) in enumerate(
        [(k, words.hashes(), words.bounds) for k in WORD_GRAMS] + [(k, code, chars) for k in CHAR_GRAMS]
    ):
        first = bounds[:-1]
        out.append((_slots(items, size, group), first, np.maximum(first, bounds[1:] - size + 1)))
    return out


class Regression:
    def __init__(self):
        self.bias, self.weights = 0.0, np.zeros(GROUPS << BITS, np.float32)
        self.scale, self.shift = 1.0, 0.0

    def raw(self, groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        total = np.full(len(groups[0][1]), self.bias)
        for slots, first, last in groups:
            sums = np.concatenate(([0.0], np.cumsum(self.weights[slots], dtype=np.float64)))
            total += (sums[last] - sums[first]) / np.maximum(1, last - first)
        return total

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * raw + self.shift, -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 11) -> None:
        """Adagrad on the log loss; every fifth row is kept back for calibration."""
        back = np.arange(len(labels)) % 5 == 4
        train, rng = np.flatnonzero(~back), np.random.default_rng(seed)
        share = np.clip(labels[train].mean(), 0.01, 0.99)
        self.bias = float(np.log(share / (1 - share)))
        seen, batches = np.full(len(self.weights), 1e-8), max(1, len(train) // BATCH_ROWS)
        for _ in range(max(EPOCHS, LEAST_STEPS // batches)):
            for part in np.array_split(rng.permutation(train), batches):
                index = np.concatenate([rows[i][0] for i in part])
                value = np.concatenate([rows[i][1] for i in part])
                sizes = [len(rows[i][0]) for i in part]
                at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                raw = self.bias + np.add.reduceat(self.weights[index] * value, at)
                gap = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[part]) / len(part)
                slope = np.bincount(index, np.repeat(gap, sizes) * value, len(self.weights))
                some = np.flatnonzero(slope)
                slope = slope[some] + DECAY * self.weights[some]
                seen[some] += slope * slope
                self.weights[some] -= (RATE * slope / np.sqrt(seen[some])).astype(np.float32)
                self.bias -= RATE * float(gap.sum())
        held = np.flatnonzero(back)
        if len(held) >= 50 and 0 < labels[held].sum() < len(held):
            raw = np.array([self.bias + (self.weights[rows[i][0]] * rows[i][1]).sum() for i in held])
            self.scale, self.shift = platt(raw, labels[held])

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, weights=self.weights, rest=[self.bias, self.scale, self.shift])
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Regression:
        model, saved = cls(), np.load(io.BytesIO(blob))
        model.weights = saved["weights"]
        model.bias, model.scale, model.shift = saved["rest"].tolist()
        return model


def _sparse(groups, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Text ``i`` as distinct weight numbers and their shares."""
    index, value = [], []
    for slots, first, last in groups:
        found, times = np.unique(slots[first[i]:last[i]], return_counts=True)
        index.append(found)
        value.append(times / max(1, last[i] - first[i]))
    return np.concatenate(index), np.concatenate(value)


def training_rows(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, quality, index, value``: n-gram shares of at most ``sample_rows`` labelled rows.

    The held-out fold of the classifiers is left out here as well.
    """
    sample = sample_of(labels, "quality", ~is_held_out(F.col("doc_id")), sample_rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in blocks(batch.column("text")):
                groups = grams(data, offsets, split(data, offsets))
                rows = [_sparse(groups, i) for i in range(len(offsets) - 1)]
                part = batch.slice(row, len(rows))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())),
                    pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32())),
                ], ["doc_id", "index", "value"])

    texts = one_text_each(documents.withColumn("doc_id", F.col("doc_id").cast("long")), sample)
    found = texts.mapInArrow(extract, "doc_id long, index array<int>, value array<float>")
    return found.join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "index", "value")


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> bytes:
    """Fit on :func:`training_rows`, which alone reach the one task that fits.

    Of rows that share an id, one text of smallest hash is learned from; it counts as
    often as the id has labels in the sample.
    """

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ys = [], []
        for batch in batches:
            ys += batch.column("quality").to_pylist()
            for i, v in zip(batch.column("index"), batch.column("value")):
                rows.append((i.values.to_numpy(), v.values.to_numpy()))
        model, y = Regression(), np.array([float(q > 0) for q in ys])
        if 0 < y.sum() < len(y):
            model.fit(rows, y)
        elif len(y):
            model.bias = 30.0 if y[0] else -30.0
        yield pa.RecordBatch.from_arrays([pa.array([model.dump()], pa.binary())], ["model"])

    ordered = training_rows(documents, labels, sample_rows).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "quality")
    fitted = ordered.mapInArrow(fit, "model binary")
    with writing(documents.sparkSession):
        fitted = fitted.collect()
    return bytes(fitted[0]["model"]) if fitted else Regression().dump()


def judge(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, rule verdict, probability and final verdict of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, labels, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Regression.load(shared.value)
        for batch in batches:
            for row, data, offsets in blocks(batch.column(1)):
                words = split(data, offsets)
                counts = base_counts(data, offsets, words)
                failed = base_failed(counts)
                score = model.probability(model.raw(grams(data, offsets, words)))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, len(failed)), *[pa.array(counts[c], pa.int64()) for c in STATS],
                    pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold)),
                ], ["doc_id", *STATS, "base_failed", "score", "kept"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
