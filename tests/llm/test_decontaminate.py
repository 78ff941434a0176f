import random

import numpy as np
import pyarrow as pa
import pytest

from glossaflow.llm import decontaminate as D
from llm import fixtures as X


def edits(a: list, b: list) -> int:
    """Edit distance of ``a`` to the nearest passage of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    word = lambda: f"b{rng.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 60)))) for k in range(30)] + [(77, None), (78, " "), (3, "twice THE id")]
    docs = X.rows(n=20)
    for k in range(60):
        words = items[k % 30][1].split()
        for _ in range(int(D.EDITS / 2 * len(words)) if k >= 30 else 0):
            words[rng.randrange(len(words))] = "other"
        around = [word() for _ in range(rng.randint(0, 80))]
        at = rng.randint(0, len(around))
        docs.append((5000 + k, " ".join(around[:at] + words + around[at:]).upper(), "", "", 1, None, None, None))
    return spark.createDataFrame(docs, X.SCHEMA).repartition(4), spark.createDataFrame(items, "item_id long, text string"), docs, items


@pytest.mark.parametrize("block", [1 << 20, 1500])
def test_hits_are_exact_and_recall_is_high(tables, monkeypatch, block):
    monkeypatch.setattr(D, "ITEM_BLOCK_BYTES", block)
    documents, benchmark, docs, items = tables
    got = {(r.doc_id, r.item_id, r.item_words): r.edits for r in D.contaminated(documents, benchmark).collect()}
    want = {}
    for d in docs:
        text = (d[1] or "").lower().split()
        for i, t in items:
            item = (t or "").lower().split()
            if item:
                n = edits(item, text)
                if n <= int(D.EDITS * len(item)):
                    want[d[0], i, len(item)] = n
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got if want[k] == 0)
    assert all(k in got for k, n in want.items() if n == 0)
    assert len(got) >= 0.9 * len(want)


def test_clean_keeps_the_rest(tables):
    documents, benchmark, docs, _ = tables
    hit = {r.doc_id for r in D.contaminated(documents, benchmark).collect()}
    kept = D.clean(documents, benchmark)
    assert kept.columns == documents.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d[0]) for d in docs if d[0] not in hit)


def test_empty_tables(spark, tables):
    documents, benchmark, docs, _ = tables
    assert D.contaminated(documents, benchmark.limit(0)).collect() == []
    assert D.clean(documents, benchmark.limit(0)).count() == len(docs)
    assert D.contaminated(documents.limit(0), benchmark).collect() == []


def test_fewest_edits():
    rng = random.Random(2)
    for _ in range(100):
        a, b = [[rng.randrange(4) for _ in range(rng.randint(1, 9))] for _ in range(2)]
        assert D.fewest_edits(np.array(a, np.uint64), np.array(b, np.uint64))[0] == edits(a, b)


@pytest.mark.parametrize("n", [5, 9, 10, 15, 19, 20, 22, 24, 30, 45])
def test_recall_of_each_length_at_the_full_threshold(n):
    """Long items of the same table do not hide the short ones."""
    rng = random.Random(n)
    draw = lambda k: [f"v{rng.randrange(10**6)}" for _ in range(k)]
    lengths = [90] * 300 + [n] * 100
    items = [draw(k) for k in lengths]
    texts = []
    for item in items[300:]:
        words = [[w] for w in item]
        for at in rng.sample(range(n), int(D.EDITS * n)):
            words[at] = rng.choice([[], draw(1), draw(1) + words[at]])
        texts.append(" ".join(draw(rng.randrange(40)) + [w for part in words for w in part] + draw(rng.randrange(40))))
    found = D.Items(list(range(len(items))), [" ".join(i) for i in items]).hits(pa.array(texts))
    assert sum(any(h["item"] == 300 + k for h in hits) for k, hits in enumerate(found)) >= 90


def test_repeated_items_are_indexed_once(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEM_BLOCK_BYTES", 400)
    sizes, build = [], D.Items.__init__

    def counted(self, ids, texts, *rest):
        sizes.append(sum(len(t) for t in texts))
        build(self, ids, texts, *rest)

    monkeypatch.setattr(D.Items, "__init__", counted)
    text = "one item that is repeated in many rows of the benchmark"
    items = [(k % 150, text) for k in range(300)] + [(1000 + k, f"another item number {k} of the table") for k in range(8)]
    documents = spark.createDataFrame([(1, f"before {text} after"), (2, "nothing")], "doc_id long, text string")
    got = D.contaminated(documents, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(r.item_id for r in got) == sorted(k % 150 for k in range(300))
    assert {(r.doc_id, r.edits, r.item_words, r.start_word) for r in got} == {(1, 0, 11, 1)}
    assert max(sizes) <= 400


def test_start_word_is_that_of_the_passage(spark):
    rng = random.Random(8)
    item, table, want = [f"i{k}" for k in range(40)], [], {}
    for k in range(40):
        passage, before = list(item), rng.randint(0, 50)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(2, len(passage) - 2)
            passage[at:at + 1] = [[], ["new", passage[at]], ["other"]][rng.randrange(3)]
        table.append((k, " ".join([f"a{rng.random()}" for _ in range(before)] + passage + ["z"] * rng.randint(0, 20))))
        want[k] = before
    got = D.contaminated(
        spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    ).collect()
    assert len(got) == 40 and {r.doc_id: r.start_word for r in got} == want
