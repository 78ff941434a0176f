"""Quality classifier: a factorisation machine over hashed words and structure.

``raw(x) = b + sum_i w_i x_i + sum_(i<j) <v_i, v_j> x_i x_j``; the pairwise part is
``(|sum_i v_i x_i|^2 - sum_i |v_i x_i|^2) / 2``, so scoring is linear in the
non-zero features. Features come from the text alone: hashed words (damped counts,
unit length), binned structure statistics, and the binned text length.

Defined results: null text is scored as the empty text; null labels are left out;
repeated label rows count as often as they occur; without any training row the
score is 0.5; without both classes it is the class seen.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaflow.llm.calibration import platt
from glossaflow.llm.labelled import one_text_each, sample_of
from glossaflow.llm.tables import writing
from glossaflow.llm.words import blocks, char_counts, per_text, split

WORD_BUCKETS = 1 << 16
RANK = 8
SAMPLE_ROWS = 8_192
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
EPOCHS, LEAST_STEPS, BATCH_ROWS, RATE, DECAY = 8, 500, 128, 0.1, 1e-3
BIN_VALUE = 1.0

# Upper bin edges of the structure statistics.
_SHARES = (0.002, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.75)
_SIZES = (1, 20, 50, 100, 250, 500, 1_000, 3_000, 10_000, 30_000)
STATISTICS = {
    "symbols": _SHARES, "exclamations": _SHARES, "capitals": _SHARES, "digits": _SHARES,
    "stops": _SHARES, "same_as_previous": _SHARES, "repeated_words": _SHARES,
    "repeated_lines": _SHARES, "word_length": (2, 3, 4, 5, 6, 7, 8, 10, 14),
    "line_words": (2, 5, 10, 20, 40, 80, 160), "chars": _SIZES, "words": _SIZES,
}
_BINS = 12
FEATURES = WORD_BUCKETS + _BINS * len(STATISTICS)


def _table(chars: str) -> np.ndarray:
    wanted = np.zeros(256, dtype=bool)
    wanted[[ord(c) for c in chars]] = True
    return wanted


_SYMBOLS, _EXCLAIM, _STOPS = _table("#*$%&|<>"), _table("!"), _table(".,;:?")
_CAPITALS = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGITS, _NEWLINE = _table("0123456789"), _table("\n")
_LEAD = np.ones(256, dtype=bool)
_LEAD[0x80:0xC0] = False


def _repeated_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of a text's lines with content that equal an earlier one."""
    out = np.zeros(len(offsets) - 1)
    whole = data.tobytes()
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        lines = [x for x in whole[a:b].split(b"\n") if x.strip()]
        if lines:
            out[i] = 1 - len(set(lines)) / len(lines)
    return out


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first row, row bounds, feature numbers, values)`` of blocks of texts."""
    for row, data, offsets in blocks(texts):
        words = split(data, offsets)
        n, size = len(offsets) - 1, max(1, len(words.vocab))
        owner, counts = words.owner, np.diff(words.bounds)
        keys, times = np.unique(owner * size + words.codes, return_counts=True)
        doc, code = keys // size, keys % size
        bucket = np.zeros(0, np.int64)
        if len(keys):
            first = np.full(size, -1)
            first[words.codes] = np.arange(len(words.codes))
            bucket = (words.hashes()[first[code]] & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)
        value = np.log1p(times)
        norm = np.sqrt(np.bincount(doc, value * value, n))
        value = value / np.maximum(norm, 1e-9)[doc]

        same = np.zeros(len(owner))
        same[1:] = (owner[1:] == owner[:-1]) & (words.codes[1:] == words.codes[:-1])
        chars = char_counts(data, _LEAD, offsets)
        per_char, per_word = np.maximum(chars, 1), np.maximum(counts, 1)
        stats = {
            "symbols": char_counts(data, _SYMBOLS, offsets) / per_char,
            "exclamations": char_counts(data, _EXCLAIM, offsets) / per_char,
            "capitals": char_counts(data, _CAPITALS, offsets) / per_char,
            "digits": char_counts(data, _DIGITS, offsets) / per_char,
            "stops": char_counts(data, _STOPS, offsets) / per_char,
            "same_as_previous": per_text(same, words.bounds) / per_word,
            "repeated_words": 1 - np.bincount(doc, minlength=n) / per_word,
            "repeated_lines": _repeated_lines(data, offsets),
            "word_length": (words.ends - words.starts).sum() and per_text(words.ends - words.starts, words.bounds) / per_word,
            "line_words": counts / (char_counts(data, _NEWLINE, offsets) + 1),
            "chars": chars, "words": counts,
        }
        bins = np.stack([
            WORD_BUCKETS + k * _BINS + np.digitize(np.broadcast_to(stats[name], n), edges)
            for k, (name, edges) in enumerate(STATISTICS.items())
        ], axis=1)
        extra = bins.shape[1]
        bounds = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n) + extra)))
        index, values = np.empty(bounds[-1], np.int64), np.full(bounds[-1], BIN_VALUE)
        place = np.arange(len(doc)) + doc * extra
        index[place], values[place] = bucket, value
        rest = np.ones(bounds[-1], dtype=bool)
        rest[place] = False
        index[rest] = bins.reshape(-1)
        yield row, bounds, index, values


class Machine:
    """Parameters, scoring and fitting."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias, self.linear = 0.0, np.zeros(FEATURES, np.float32)
        self.factors = rng.normal(0, 0.01, (FEATURES, RANK)).astype(np.float32)
        self.scale, self.shift = 1.0, 0.0

    def raw(self, bounds: np.ndarray, index: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Linear part, and pairs by the sum-of-squares identity."""
        vx = self.factors[index] * values[:, None].astype(np.float32)
        at = bounds[:-1]
        total = np.add.reduceat(vx, at, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), at)
        line = np.add.reduceat(self.linear[index] * values, at)
        return self.bias + line + ((total * total).sum(axis=1) - squares) / 2

    def score(self, *x: np.ndarray) -> np.ndarray:
        raw = np.clip(self.scale * self.raw(*x) + self.shift, -30, 30)
        return 1 / (1 + np.exp(-raw))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> None:
        """Adagrad on the log loss; every fifth row is kept back for calibration."""
        back = np.arange(len(labels)) % 5 == 4
        train, rng = np.flatnonzero(~back), np.random.default_rng(seed)
        share = np.clip(labels[train].mean(), 0.01, 0.99)
        self.bias = float(np.log(share / (1 - share)))
        sums = np.full(FEATURES, 1e-6), np.full((FEATURES, RANK), 1e-6)
        batches = max(1, len(train) // BATCH_ROWS)
        for _ in range(max(EPOCHS, LEAST_STEPS // batches)):
            for part in np.array_split(rng.permutation(train), batches):
                x = _stack([rows[i] for i in part])
                self._step(x, labels[part], sums)
        held = np.flatnonzero(back)
        if len(held) >= 50 and 0 < labels[held].sum() < len(held):
            self.scale, self.shift = platt(self.raw(*_stack([rows[i] for i in held])), labels[held])

    def _step(self, x, labels, sums) -> None:
        bounds, index, values = x
        gap = (1 / (1 + np.exp(-np.clip(self.raw(*x), -30, 30))) - labels) / len(labels)
        each = np.repeat(gap, np.diff(bounds)) * values
        vx = self.factors[index] * values[:, None]
        total = np.repeat(np.add.reduceat(vx, bounds[:-1], axis=0), np.diff(bounds), axis=0)
        order = np.argsort(index, kind="stable")
        known = index[order]
        at = np.flatnonzero(np.concatenate(([True], known[1:] != known[:-1])))
        touched = known[at]
        slopes = (
            np.add.reduceat(each[order], at) + DECAY * self.linear[touched],
            np.add.reduceat((each[:, None] * (total - vx))[order], at, axis=0) + DECAY * self.factors[touched],
        )
        for weights, seen, slope in zip((self.linear, self.factors), sums, slopes):
            seen[touched] += slope * slope
            weights[touched] -= (RATE * slope / np.sqrt(seen[touched])).astype(np.float32)
        self.bias -= RATE * float(gap.sum())

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, linear=self.linear, factors=self.factors, rest=[self.bias, self.scale, self.shift])
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Machine:
        model, saved = cls(), np.load(io.BytesIO(blob))
        model.linear, model.factors = saved["linear"], saved["factors"]
        model.bias, model.scale, model.shift = saved["rest"].tolist()
        return model


def _stack(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = [len(i) for i, _ in rows]
    return (
        np.concatenate(([0], np.cumsum(sizes))),
        np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]),
    )


def is_held_out(doc_id: Column) -> Column:
    """Rows of the fold whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT


def training_rows(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, quality, index, value``: features of at most ``sample_rows`` labelled rows outside the held-out fold."""
    sample = sample_of(labels, "quality", ~is_held_out(F.col("doc_id")), sample_rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, bounds, index, values in features(batch.column("text")):
                part = batch.slice(row, len(bounds) - 1)
                offsets = pa.array(bounds, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(index, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(values, pa.float32())),
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
                rows.append((i.values.to_numpy().astype(np.int64), v.values.to_numpy().astype(np.float64)))
        model, labels = Machine(), np.array([float(y > 0) for y in ys])
        if 0 < labels.sum() < len(labels):
            model.fit(rows, labels)
        elif len(labels):
            model.bias = 30.0 if labels[0] else -30.0
        yield pa.RecordBatch.from_arrays([pa.array([model.dump()], pa.binary())], ["model"])

    ordered = training_rows(documents, labels, sample_rows).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "quality")
    fitted = ordered.mapInArrow(fit, "model binary")
    with writing(documents.sparkSession):
        fitted = fitted.collect()
    return bytes(fitted[0]["model"]) if fitted else Machine().dump()


def scorer(spark: SparkSession, model: bytes):
    """A function ``text column -> score column``. The model has a fixed size."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = Machine.load(shared.value)
        for texts in parts:
            out = np.zeros(len(texts))
            for row, bounds, index, values in features(texts):
                out[row:row + len(bounds) - 1] = machine.score(bounds, index, values)
            yield pa.array(out, pa.float64())

    return score


def classify(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    score = scorer(documents.sparkSession, train(documents, labels, sample_rows))
    scored = documents.select("doc_id", score("text").alias("score"))
    return scored.select(
        "doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents the classifier accepts, with their own columns."""
    score = scorer(documents.sparkSession, train(documents, labels, sample_rows))
    return documents.filter(score(documents["text"]) >= threshold)
