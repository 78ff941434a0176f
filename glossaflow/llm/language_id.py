"""Language identification: a convolutional network over bytes.

A text is cut into windows of a fixed number of bytes, the last one padded. Bytes are
embedded; filters of several widths run over each window, the largest response of each
filter is kept (max pooling), and one dense layer with softmax gives the probability
of every language. A text's probabilities are the mean over all its windows, each
weighted by its bytes. Training and scoring are numpy; weights are found by Adam on the
cross entropy of windows.

The network learns from a bounded sample: the ``LANGUAGES`` languages of most rows, per
language the ``SAMPLE_TEXTS`` distinct texts of smallest hash, and at most
``SAMPLE_WINDOWS`` windows of each, spread evenly. Copies count once, so no text, id or
language can fill the sample.

Defined results: null texts and texts without a letter are ``und`` with score 0, as are
all texts when there is nothing to learn from; a null language is not learned; with one
language every text with a letter is of it; repeated rows are scored alike; a row
without an id is scored, not held out, and not learned from.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossaflow.llm.quality_fm import is_held_out
from glossaflow.llm.tables import writing
from glossaflow.llm.words import blocks

WINDOW, DIMS, WIDTHS, FILTERS = 256, 6, (2, 3, 5), 12
WIDEST = max(WIDTHS)
LANGUAGES, SAMPLE_TEXTS, SAMPLE_WINDOWS = 256, 512, 4
SHARES = 64
EPOCHS, LEAST_STEPS, BATCH, RATE = 4, 300, 128, 0.01
UNKNOWN = "und"
PAD = 256
SCORED_AT_ONCE = 256

# Weights of a filter that lie inside its width.
INSIDE = (np.arange(WIDEST * DIMS)[:, None] < np.repeat(WIDTHS, FILTERS) * DIMS).astype(np.float32)
# Pads behind a window: each byte starts a patch, and a window holds whole patches.
_TAIL = WIDEST - 1 + -(WINDOW + WIDEST - 1) % WIDEST

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


class Network:
    """Embedding, filters of all widths side by side, dense layer."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng, pooled = np.random.default_rng(seed), FILTERS * len(WIDTHS)
        normal = lambda *shape, by: (rng.normal(size=shape) / np.sqrt(by)).astype(np.float32)
        self.languages = languages
        self.weights = {
            "bytes": normal(PAD + 1, DIMS, by=1), "filters": normal(WIDEST * DIMS, pooled, by=WIDEST * DIMS) * INSIDE,
            "shift": np.zeros(pooled, np.float32), "dense": normal(pooled, len(languages), by=pooled),
            "bias": np.zeros(len(languages), np.float32),
        }
        self.weights["bytes"][PAD] = 0

    def responses(self, windows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """``(r, responses at the bytes r, r + WIDEST, ...)`` of every window and filter.

        Windows are a multiple of the widest filter long, so patches that start at every
        ``WIDEST``-th byte are rows of the embedded bytes as they lie: nothing is copied.
        """
        n, flat = len(windows), self.weights["bytes"][windows].reshape(-1)
        each = windows.shape[1] // WIDEST
        for r in range(WIDEST):
            rows = flat[r * DIMS:len(flat) - (WIDEST - r) % WIDEST * DIMS].reshape(-1, WIDEST * DIMS)
            out = rows @ self.weights["filters"]
            if r:
                # The last patch of a window would reach into the next one.
                whole = np.empty((n * each, out.shape[1]), np.float32)
                whole[:-1] = out
                yield r, whole.reshape(n, each, -1)[:, :-1]
            else:
                yield r, out.reshape(n, each, -1)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Largest response of every filter."""
        best = None
        for _, out in self.responses(windows):
            top = out.max(axis=1)
            best = top if best is None else np.maximum(best, top)
        return np.maximum(best + self.weights["shift"], 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return _softmax(self.pooled(windows) @ self.weights["dense"] + self.weights["bias"])

    def slopes(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean cross entropy; only pooled places carry any."""
        n = len(windows)
        grid = np.full((n, WINDOW, len(self.weights["shift"])), -np.inf, np.float32)
        for r, out in self.responses(windows):
            places = grid[:, r::WIDEST]
            places[:] = out[:, :places.shape[1]]
        at = grid.argmax(axis=1)
        hidden = np.maximum(np.take_along_axis(grid, at[:, None], axis=1)[:, 0] + self.weights["shift"], 0)
        gap = _softmax(hidden @ self.weights["dense"] + self.weights["bias"])
        gap[np.arange(n), labels] -= 1
        gap /= n
        back = (gap @ self.weights["dense"].T) * (hidden > 0)
        seen = windows[np.arange(n)[:, None, None], at[:, :, None] + np.arange(WIDEST)]
        patch = self.weights["bytes"][seen].reshape(n, -1, WIDEST * DIMS)
        flow = (back[:, :, None] * self.weights["filters"].T).reshape(-1, DIMS)
        embedded = np.zeros_like(self.weights["bytes"])
        np.add.at(embedded, seen.ravel(), flow)
        embedded[PAD] = 0
        return {
            "bytes": embedded, "filters": np.einsum("nf,nfd->df", back, patch) * INSIDE, "shift": back.sum(axis=0),
            "dense": hidden.T @ gap, "bias": gap.sum(axis=0),
        }

    def fit(self, windows: np.ndarray, labels: np.ndarray, seed: int = 7) -> None:
        """Adam; every language weighs alike in the draws of a batch."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        share = (1 / np.bincount(labels, minlength=len(self.languages)).clip(1))[labels]
        steps = max(LEAST_STEPS, EPOCHS * len(labels) // BATCH)
        for step in range(1, steps + 1):
            part = rng.choice(len(labels), BATCH, p=share / share.sum())
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for name, slope in self.slopes(windows[part], labels[part]).items():
                mean[name] += 0.1 * (slope - mean[name])
                square[name] += 0.01 * (slope * slope - square[name])
                upward = np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8
                self.weights[name] -= (rate * mean[name] / (1 - 0.9**step) / upward).astype(np.float32)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, languages=np.array(self.languages, dtype=str), **self.weights)
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Network:
        saved = np.load(io.BytesIO(blob))
        model = cls(saved["languages"].tolist())
        model.weights = {k: saved[k] for k in saved.files if k != "languages"}
        return model


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, text, and bytes held of all windows of some texts."""
    sizes = np.diff(offsets)
    many = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), many)
    first = np.concatenate(([0], np.cumsum(many)))
    start = offsets[:-1][owner] + WINDOW * (np.arange(len(owner)) - first[owner])
    return start, owner, np.minimum(offsets[1:][owner] - start, WINDOW)


def cut(data: np.ndarray, start: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Byte numbers of windows, with pads behind what they hold."""
    place = np.arange(WINDOW + _TAIL)
    inside = place < held[:, None]
    return np.where(inside, data[np.where(inside, start[:, None] + place, 0)], np.int16(PAD))


def mean_probabilities(model: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of each language for every text, over all its windows."""
    start, owner, held = windows(offsets)
    total = np.zeros((len(offsets) - 1, len(model.languages)))
    for at in range(0, len(start), SCORED_AT_ONCE):
        part = slice(at, at + SCORED_AT_ONCE)
        shares = model.probabilities(cut(data, start[part], held[part]))
        np.add.at(total, owner[part], shares * held[part, None])
    return total / np.maximum(np.diff(offsets), 1)[:, None]


def _spread(text: Column, many: int) -> Column:
    """At most ``many`` windows of a text's bytes, evenly spread from its first to its last."""
    raw = F.encode(text, "UTF-8")
    size = F.octet_length(text)
    n = F.least(F.lit(many), F.ceil(size / WINDOW).cast("int"))
    last = F.greatest(size - WINDOW, F.lit(0))
    at = lambda k: (last.cast("long") * k / F.greatest(n - 1, F.lit(1))).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(raw, at(k) + 1, F.lit(WINDOW)))


def has_letter(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False))


def sample(documents: DataFrame, texts: int = SAMPLE_TEXTS, many: int = SAMPLE_WINDOWS) -> DataFrame:
    """``lang, h, windows`` of the texts to learn from.

    Hashes alone decide which; only the chosen texts' windows are then fetched.
    """
    usable = documents.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id")) & has_letter(F.col("text"))
    ).withColumn("h", F.xxhash64("text"))
    chosen = usable.select("lang", "h", F.pmod("h", F.lit(SHARES)).alias("_share")).distinct()
    # First inside shares of a language's texts, so that no task sees more than a few shares' choice.
    for by in (("lang", "_share"), ("lang",)):
        order = Window.partitionBy(*by).orderBy("h")
        chosen = chosen.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= texts)
    named = documents.filter(F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("_rows"))
    named = named.orderBy(F.desc("_rows"), "lang").limit(LANGUAGES).select("lang")
    # At most LANGUAGES * texts numbers.
    wanted = F.broadcast(chosen.join(F.broadcast(named), "lang").select("lang", "h"))
    return usable.join(wanted, ["lang", "h"]).select("lang", "h", _spread(F.col("text"), many).alias("windows")).groupBy(
        "lang", "h"
    ).agg(F.min("windows").alias("windows"))


def train(documents: DataFrame, texts: int = SAMPLE_TEXTS, many: int = SAMPLE_WINDOWS) -> bytes:
    """Weights of a network that learned the languages of ``documents``."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, raw = [], []
        for batch in batches:
            for lang, cuts in zip(batch.column("lang").to_pylist(), batch.column("windows").to_pylist()):
                raw += cuts
                langs += [lang] * len(cuts)
        names = sorted(set(langs))
        model = Network(names)
        if len(names) > 1:
            start, owner, held = windows(np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
            model.fit(cut(np.frombuffer(b"".join(raw), np.uint8), start, held), np.searchsorted(names, langs)[owner])
        yield pa.RecordBatch.from_arrays([pa.array([model.dump()], pa.binary())], ["model"])

    rows = sample(documents, texts, many).repartition(1).sortWithinPartitions("lang", "h")
    fitted = rows.mapInArrow(fit, "model binary")
    with writing(documents.sparkSession):
        fitted = fitted.collect()
    return bytes(fitted[0]["model"]) if fitted else Network([]).dump()


def identify(documents: DataFrame, texts: int = SAMPLE_TEXTS, many: int = SAMPLE_WINDOWS) -> DataFrame:
    """Language and its probability of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, texts, many))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network.load(shared.value)
        names = np.array(model.languages + [UNKNOWN], dtype=object)
        for batch in batches:
            for row, data, offsets in blocks(batch.column("text")):
                n = len(offsets) - 1
                lettered = batch.column("lettered").slice(row, n).to_numpy(zero_copy_only=False)
                best, score = np.full(n, len(names) - 1), np.zeros(n)
                if model.languages:
                    shares = mean_probabilities(model, data, offsets)
                    best = np.where(lettered, shares.argmax(axis=1), best)
                    score = np.where(lettered, shares.max(axis=1).clip(0, 1), score)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(row, n), batch.column("held_out").slice(row, n),
                    pa.array(names[best], pa.string()), pa.array(score),
                ], ["doc_id", "held_out", "lang_pred", "score"])

    doc_id = F.col("doc_id").cast("long")
    return documents.select(
        doc_id.alias("doc_id"), F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text",
        has_letter(F.col("text")).alias("lettered"),
    ).mapInArrow(run, SCHEMA)
