"""Byte convolutional network: gradient, pooling, held-out accuracy, awkward rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossaflow.llm import language_id as L
from llm import fixtures as X

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def bytes_of(*texts: str) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))


def plain_windows(text: str) -> list[list[int]]:
    raw = text.encode()
    whole = [list(raw[k:k + L.WINDOW]) for k in range(0, len(raw), L.WINDOW)]
    return [w + [L.PAD] * (L.WINDOW + L._TAIL - len(w)) for w in whole]


def test_windows_hold_every_byte_once():
    texts = ["a", "é" * 200, "", "x" * L.WINDOW, "y" * (3 * L.WINDOW + 1)]
    data, offsets = bytes_of(*texts)
    start, owner, held = L.windows(offsets)
    want = [(k, w) for k, t in enumerate(texts) for w in plain_windows(t)]
    assert owner.tolist() == [k for k, _ in want]
    assert L.cut(data, start, held).tolist() == [w for _, w in want]
    assert held.sum() == len(data)


def test_pooling_equals_plain_convolution():
    net = L.Network(["a", "b"])
    data, offsets = bytes_of("some text, not long", "z" * 300 + "end")
    start, _, held = L.windows(offsets)
    cut = L.cut(data, start, held)
    got = net.pooled(cut)
    for n, window in enumerate(cut):
        at = 0
        for width in L.WIDTHS:
            for f in range(L.FILTERS):
                weights = net.weights["filters"][:width * L.DIMS, at]
                sums = [
                    float(net.weights["bytes"][window[p:p + width]].reshape(-1) @ weights)
                    for p in range(L.WINDOW)
                ]
                assert got[n, at] == pytest.approx(max(0, max(sums) + net.weights["shift"][at]), abs=1e-4)
                at += 1


def test_gradient_equals_difference():
    net, rng = L.Network(["a", "b", "c"]), np.random.default_rng(0)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    data, offsets = bytes_of(*["".join(chr(c) for c in rng.integers(97, 122, 400)) for _ in range(4)])
    start, _, held = L.windows(offsets)
    cut, labels = L.cut(data, start, held), np.arange(len(start)) % 3
    slopes = net.slopes(cut, labels)

    def loss() -> float:
        return -np.log(net.probabilities(cut)[np.arange(len(labels)), labels]).mean()

    for name, slope in slopes.items():
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        net.weights[name][at] += 1e-4
        up = loss()
        net.weights[name][at] -= 2e-4
        assert (up - loss()) / 2e-4 == pytest.approx(slope[at], rel=1e-2)
        net.weights[name][at] += 1e-4


def test_right_on_held_out_rows(documents):
    rows = L.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == documents.count()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if r.held_out}
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_learns_nothing_from_held_out_rows_nor_from_copies(documents):
    few = documents.filter("doc_id < 200")
    odd = few.withColumn("lang", F.when(L.is_held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    learned = L.sample(few).orderBy("lang", "h").collect()
    assert learned == L.sample(odd.unionAll(few).unionAll(few)).orderBy("lang", "h").collect()
    few_texts = L.sample(few, texts=3).groupBy("lang").count().collect()
    assert few_texts and all(r["count"] <= 3 for r in few_texts)


def test_awkward_rows(spark, documents):
    long = "The thing and the other thing of that. " * 30_000
    table = [(1, None), (2, ""), (3, "12 34 !"), (4, "thing and that"), (None, "thing and that"), (4, "thing and that"),
             (5, long), (6, "é")]
    odd = spark.createDataFrame(
        [(i, t, None, None, 1, None, None, None) for i, t in table], X.SCHEMA
    )
    rows = L.identify(odd.unionByName(documents.limit(200), allowMissingColumns=True)).collect()
    mine = [r for r in rows if r.doc_id in (None, 1, 2, 3, 4, 5, 6)]
    by_id = {}
    for r in mine:
        by_id.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert all((L.UNKNOWN, 0.0) in by_id[k] for k in (1, 2, 3))
    assert len(by_id[4]) >= 2 and by_id[None][0] in by_id[4]
    assert not [r for r in mine if r.doc_id is None][0].held_out
    assert any(p == "en" for p, _ in by_id[5])
    nothing = L.identify(odd).collect()
    assert len(nothing) == len(table) and {(r.lang_pred, r.score) for r in nothing} == {(L.UNKNOWN, 0.0)}
    assert L.identify(odd.limit(0)).collect() == []
    one = L.identify(odd.fillna({"lang": "zz"})).collect()
    assert {r.lang_pred for r in one} == {"zz", L.UNKNOWN}
