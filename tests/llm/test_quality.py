"""Classifiers: identities, held-out accuracy, and counts against plain restatements."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from glossaflow.llm import quality_fm as F
from glossaflow.llm import quality_rules as R
from glossaflow.llm.calibration import platt
from glossaflow.llm.words import split, utf8
from llm import fixtures as X

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_sum_of_squares_identity():
    model, rng = F.Machine(), np.random.default_rng(0)
    model.linear = rng.normal(size=F.FEATURES).astype(np.float32)
    model.factors = rng.normal(size=(F.FEATURES, F.RANK)).astype(np.float32)
    (_, bounds, index, values), = F.features(pa.array(["a b b c", None, "x ## y"]))
    got = model.raw(bounds, index, values)
    for k in range(3):
        i, v = index[bounds[k]:bounds[k + 1]], values[bounds[k]:bounds[k + 1]]
        pairs = sum(model.factors[i[a]] @ model.factors[i[b]] * v[a] * v[b] for a in range(len(i)) for b in range(a))
        assert np.isclose(got[k], model.linear[i] @ v + pairs, rtol=1e-3)


def test_classifier_is_right_on_held_out_rows(corpus):
    documents, labels = corpus
    rows = F.classify(documents, labels).collect()
    assert len(rows) == documents.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.93 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_classifiers_do_not_learn_from_the_held_out_fold(corpus):
    documents, labels = corpus
    flipped = labels.withColumn("quality", labels.quality - 2 * labels.quality * F.is_held_out(labels.doc_id).cast("int") + F.is_held_out(labels.doc_id).cast("int"))
    assert F.train(documents, labels) == F.train(documents, flipped)


def test_rules_count_like_the_restatement(spark, corpus):
    table = X.rows() + [(9001, "# a | b\n# a | b\na b c a b c\n&", "", "", 1, None, None, None), (9002, "z " * 80, "", "", 1, None, None, None)]
    rows = R.judge(spark.createDataFrame(table, X.SCHEMA).repartition(3), corpus[1].limit(0)).collect()
    texts = {r[0]: r[1] for r in table}
    assert len(rows) == len(table)
    for r in rows:
        want = X.base_counts(texts[r.doc_id])
        assert tuple(r[c] for c in R.STATS) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed and r.score >= R.THRESHOLD) and r.score == 0.5


def test_rules_are_right_on_held_out_rows(corpus):
    documents, labels = corpus
    rows = R.judge(documents, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.filter(F.is_held_out(labels.doc_id)).collect()}
    held = [r for r in rows if r.doc_id in truth]
    assert sum((r.score >= R.THRESHOLD) == (truth[r.doc_id] == 1) for r in held) >= 0.93 * len(held)


def test_labels_with_nulls_and_no_rows(spark):
    documents = spark.createDataFrame(X.rows(), X.SCHEMA)
    labels = spark.createDataFrame([(None, 1), (100, None), (101, 1)], "doc_id long, quality int")
    assert {r.predicted for r in F.classify(documents, labels).collect()} == {1}
    assert F.keep_good(documents, labels).columns == documents.columns
    empty = spark.createDataFrame([], X.SCHEMA)
    assert F.classify(empty, labels).collect() == R.judge(empty, labels).collect() == []


def test_platt_survives_separable_classes():
    raw, y = np.array([-9.0, -8, 8, 9] * 20), np.array([0.0, 0, 1, 1] * 20)
    a, b = platt(raw, y)
    assert 0 < a < 100 and abs(b) < 100
    p = 1 / (1 + np.exp(-(a * raw + b)))
    assert (p[y == 0] < 0.1).all() and (p[y == 1] > 0.9).all()


@pytest.mark.parametrize("module", [F, R])
def test_a_hot_labelled_id_sends_one_row_per_label_to_the_fit(spark, module):
    table = [(1, f"text number {k % 5} of the hot id") for k in range(3_000)] + [(k, f"other {k} words") for k in range(2, 800)]
    documents = spark.createDataFrame(table, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame(
        [(1, 1), (1, 1), (1, 0), (None, 1), (5, None)] + [(k, k % 2) for k in range(2, 60)], "doc_id long, quality int")
    rows = module.training_rows(documents, labels).collect()
    used = [r.doc_id for r in rows]
    assert used.count(1) == 3 and len({tuple(r["index"]) for r in rows if r.doc_id == 1}) == 1
    assert len(used) == 3 + sum(1 for k in range(2, 60) if zlib.crc32(str(k).encode()) % 5 and k != 1)
    few = module.training_rows(documents, labels, sample_rows=4).collect()
    assert len(few) == 4


ODD_TEXTS = [
    "", None, "one", "A b, a b!\nA b, a b!\n# x | y", "Été straße 天气 e" * 9, "word " * 300, "\n\n  \t\n", "x1 22 three. four; 5?\nsix seven",
]


def word_hashes(text: str) -> list[int]:
    data = np.frombuffer(text.encode(), np.uint8)
    return split(data, np.array([0, len(data)])).hashes().tolist()


def test_rules_score_equals_the_mean_weight_of_each_kind_of_gram():
    model, mask = R.Regression(), (1 << 64) - 1
    model.weights = np.random.default_rng(3).normal(size=len(model.weights)).astype(np.float32)
    model.bias = 0.25

    def slot(gram: list[int], group: int) -> int:
        h = 0
        for item in gram:
            h = (h + item) * int(R._STEP) & mask
            h ^= h >> 31
        return (group << R.BITS) + ((h * int(R._STEP) & mask) >> (64 - R.BITS))

    data, offsets = utf8(pa.array(ODD_TEXTS))
    got = model.raw(R.grams(data, offsets, split(data, offsets)))
    for k, text in enumerate(ODD_TEXTS):
        text, want = text or "", model.bias
        for group, (size, items) in enumerate([(n, word_hashes(text)) for n in R.WORD_GRAMS] + [(n, [ord(c) for c in text]) for n in R.CHAR_GRAMS]):
            grams = [items[i:i + size] for i in range(len(items) - size + 1)]
            want += sum(float(model.weights[slot(g, group)]) for g in grams) / max(1, len(grams))
        assert got[k] == pytest.approx(want, abs=1e-4)


def test_machine_features_equal_the_restatement():
    for row, bounds, index, values in F.features(pa.array(ODD_TEXTS)):
        for i in range(len(bounds) - 1):
            text = ODD_TEXTS[row + i] or ""
            found = sorted(zip(index[bounds[i]:bounds[i + 1]].tolist(), values[bounds[i]:bounds[i + 1]].tolist()))
            words, hashes = X.words_of(text), word_hashes(text)
            times = {w: words.count(w) for w in words}
            norm = sum(np.log1p(n) ** 2 for n in times.values()) ** 0.5
            want = [(dict(zip(words, hashes))[w] % F.WORD_BUCKETS, np.log1p(n) / norm) for w, n in times.items()]
            n, chars, lines = max(1, len(words)), max(1, len(text)), [x for x in text.split("\n") if X.words_of(x)]
            share = lambda signs: sum(text.count(s) for s in signs) / chars
            stats = {
                "symbols": share("#*$%&|<>"), "exclamations": share("!"), "capitals": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
                "digits": share("0123456789"), "stops": share(".,;:?"),
                "same_as_previous": sum(a == b for a, b in zip(words, words[1:])) / n, "repeated_words": 1 - len(times) / n,
                "repeated_lines": 1 - len({x.encode() for x in lines}) / len(lines) if lines else 0,
                "word_length": sum(map(len, words)) / n, "line_words": len(words) / (text.count("\n") + 1),
                "chars": len(text), "words": len(words),
            }
            for k, (name, edges) in enumerate(F.STATISTICS.items()):
                want.append((F.WORD_BUCKETS + k * F._BINS + sum(stats[name] >= e for e in edges), F.BIN_VALUE))
            assert [x for x, _ in found] == [x for x, _ in sorted(want)], (text, name)
            assert [v for _, v in found] == pytest.approx([v for _, v in sorted(want)])
