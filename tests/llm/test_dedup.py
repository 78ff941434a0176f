"""Near-duplicate operators against plain restatements."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from glossaflow.llm import line_dedup, ngram_join, prefix_join, substring_dedup
from glossaflow.llm.components import components
from llm import fixtures as X


@pytest.fixture(scope="module")
def table():
    return X.rows()


@pytest.fixture(scope="module")
def documents(spark, table):
    return spark.createDataFrame(table, X.SCHEMA).repartition(5)


def test_ngram_join_finds_all_classes(documents, table):
    got = ngram_join.near_duplicates(documents).collect()
    assert len(got) == len(table)
    want, sets = X.classes(table), {r[0]: X.shingles(r[1]) for r in table}
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)


def test_orders_of_tokens_equal_two_stable_sorts():
    rng = np.random.default_rng(5)
    for n, size in ((1, 1), (1, 60), (900, 9_000), (70_000, 8_000)):
        owner = rng.integers(0, n, size)
        tokens = rng.integers(0, 2**64, size, dtype=np.uint64)
        # Equal tokens, and tokens that differ in their lowest bits only.
        tokens[::3], tokens[1::3] = tokens[0], tokens[1::3] & np.uint64(7)
        rarity = rng.integers(0, 9, size).astype(np.uint16)
        want = np.lexsort((tokens, owner))
        first, then = prefix_join._ascending(owner, tokens, n)
        assert (first == owner[want]).all() and (then == tokens[want]).all()
        assert (prefix_join._by_rarity(owner, rarity) == np.lexsort((rarity, owner))).all()
        wide = owner.astype(np.int64) << 40
        assert (prefix_join._by_rarity(wide, rarity) == np.lexsort((rarity, wide))).all()


def test_runs_without_pairs_make_no_batches(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)
    build = prefix_join._batch

    def counting(schema, rows, /, **columns):
        made.add(1)
        return build(schema, rows, **columns)

    # 20 words that 40 lines share each, too late in the prefix to make a pair.
    # token, part, doc, line, e, n, pos, sig, more, before
    rows = [(t, 0, k, 1, k, 10, 5, 0, 0, -1 - k) for t in range(20) for k in range(40)]
    postings = spark.createDataFrame(rows, prefix_join.POSTING)
    monkeypatch.setattr(prefix_join, "_batch", counting)
    monkeypatch.setattr(prefix_join, "BULK", 8)
    assert prefix_join.candidates(postings, 80, 1_024).filter("kind = 0").count() == 0
    assert made.value == 0


def test_postings_and_counts_travel_in_blocks(spark):
    """A task hands over some hundred rows for thousands of prefix tokens and counts."""
    table = [(k, " ".join(f"w{(k * 7 + j * j) % 5_003}" for j in range(60))) for k in range(2_000)]
    documents = spark.createDataFrame(table, "doc_id long, text string").coalesce(1)
    made = prefix_join.describe(documents, line_dedup.line_sets)
    counts = prefix_join.frequencies(made)
    assert counts.sum() == sum(len(set(text.split())) for _, text in table)
    assert made.filter("kind = 1").count() <= prefix_join.SKETCH // prefix_join.SLICE
    blocks = prefix_join.postings(documents, line_dedup.line_sets, counts, 80)
    assert blocks.count() <= prefix_join.BUCKETS
    rows = np.concatenate([np.frombuffer(r.postings, prefix_join.RECORD) for r in blocks.collect()])
    assert len(rows) >= 2_000 * 13 and len({(r["token"], r["e"]) for r in rows}) == len(rows)


def test_the_first_copy_in_a_task_stands_for_all(spark):
    table = [(k, "same words in every text") for k in range(50)]
    documents = spark.createDataFrame(table, "doc_id long, text string").coalesce(1)
    counts = prefix_join.frequencies(prefix_join.describe(documents, line_dedup.line_sets))
    blocks = prefix_join.postings(documents, line_dedup.line_sets, counts, 80).collect()
    rows = np.concatenate([np.frombuffer(r.postings, prefix_join.RECORD) for r in blocks])
    assert len(rows) == 2 and set(rows["doc"]) == {0}


@pytest.mark.parametrize("at_once", [40, 1 << 18])
def test_candidates_are_all_pairs_that_pass(spark, monkeypatch, at_once):
    monkeypatch.setattr(prefix_join, "COMPARED_AT_ONCE", at_once)
    rng = random.Random(at_once)
    rows = []
    for token in range(40):
        for k in range(rng.choice([1, 2, 3, 20, 60])):
            n = rng.randint(1, 90)
            near = rng.getrandbits(64) >> 1 if rng.random() < 0.9 else 7
            # token, part, doc, line, e, n, pos, sig, more, before
            rows.append((token, 0, rng.randint(0, 9), k, len(rows) + 1, n, rng.randint(0, n // 5), near, near & 3, -1 - rng.randint(0, 5)))
    want = set()
    for x in rows:
        for y in rows:
            if x[0] == y[0] and x[4] < y[4] and x[9] != y[9]:
                at = [np.array([v], np.int64) for c in (5, 6, 7, 8) for v in (x[c], y[c])]
                ok, apart = prefix_join.passes(80, *at)
                if ok[0]:
                    want.add((x[4], y[4], int(apart[0])))
    found = prefix_join.candidates(spark.createDataFrame(rows, prefix_join.POSTING), 80, 1_024).collect()
    assert {(r.a, r.b, r.n) for r in found} == want and len(want) > 5
    assert all(r.kind == prefix_join.PAIR for r in found)


def test_texts_that_nothing_asks_for_are_not_shuffled(spark):
    rows = spark.range(20_000).selectExpr("id AS doc", "id * 7 AS h")
    wanted = rows.filter("doc % 100 = 0 OR doc IS NULL")
    left = {r.doc for r in prefix_join.sieved(rows, wanted, "doc", "h").collect()}
    assert left >= set(range(0, 20_000, 100)) and len(left) < 220
    assert prefix_join.sieved(rows, wanted.limit(0), "doc", "h").count() == 0


def test_line_dedup_reads_the_texts_once_for_the_sets_of_a_round(spark, monkeypatch):
    """Nearest candidates that fail leave others to compare, from the same sets."""
    fetched = []
    fetch = line_dedup._fetch
    monkeypatch.setattr(line_dedup, "_fetch", lambda *args: fetched.append(1) or fetch(*args))
    rng, table = random.Random(8), []
    for group in range(30):
        words = [f"g{group}w{k}" for k in range(60)]
        for copy in range(8):
            # The first two are alike; the others differ from them by about as much as is allowed.
            changed = set(rng.sample(range(60), copy if copy < 2 else rng.randint(6, 8)))
            own = [f"x{rng.randrange(10**12)}" if k in changed else w for k, w in enumerate(words)]
            table.append((group * 8 + copy, " ".join(own)))
    gone = line_dedup.later_lines(spark.createDataFrame(table, "doc_id long, text string")).collect()
    sets = {k: set(text.split()) for k, text in table}
    want = {k for k in sets if any(j < k and X.similar(sets[j], sets[k]) for j in range(k - k % 8, k))}
    assert {r.doc for r in gone} == want and len(want) > 30
    assert len(fetched) == 1


@pytest.mark.parametrize("part_rows", [1, 1 << 16])
def test_ngram_join_with_hot_and_salted_tokens(spark, monkeypatch, part_rows):
    """Near copies of one text: every shared token is hot, and cut into parts."""
    monkeypatch.setattr(prefix_join, "PART_ROWS", part_rows)
    base = [f"t{k}" for k in range(60)]
    rows = []
    for i in range(40):
        w = list(base)
        for j in range(i % 4):
            w[(i * 7 + j * 13) % 60] = f"c{i}_{j}"
        rows.append((i, " ".join(w)))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = X.classes(rows)
    assert {r.doc_id: r.component_id for r in got} == want


def test_bitmaps_lose_no_similar_pair_and_tell_others_apart():
    rng, percent = np.random.default_rng(9), 80
    pairs = [([], []), ([3], [3]), (range(1, 65), range(1, 66))]
    for n in (60, 65, 128, 129, 300, 2_000, 9_000):
        for shared in (1.0, 0.95, 0.9, 0.89, 0.8, 0.5, 0.0):
            for ratio in (0.81, 1.0, 1.24):
                both = rng.integers(0, 2**64, n, dtype=np.uint64)
                own = rng.integers(0, 2**64, max(0, int(n * ratio) - int(n * shared)), dtype=np.uint64)
                pairs.append((both, np.concatenate((both[:int(n * shared)], own))))
    columns, sizes = [], []
    for side in zip(*pairs):
        sets = [np.unique(np.array(x, np.uint64)) for x in side]
        sizes.append(np.array([len(x) for x in sets]))
        column = prefix_join.bitmaps(np.append(0, np.cumsum(sizes[-1])), np.concatenate(sets))
        # As a slice that does not begin at the first row, too.
        columns.append(pa.concat_arrays([pa.array([b"?"]), column]).slice(1))
        assert [len(x or b"") for x in column.to_pylist()] == [1 << (n - 1).bit_length() >> 3 if n > 64 else 0 for n in sizes[-1].tolist()]
    ok = prefix_join.bitmaps_allow(*columns, *sizes, percent)
    told_apart = 0
    for (x, y), may in zip(pairs, ok):
        x, y = {int(v) for v in x}, {int(v) for v in y}
        if 100 * len(x & y) >= percent * len(x | y):
            assert may
        elif min(len(x), len(y)) > 64 and 100 * len(x & y) < 70 * len(x | y):
            assert not may
            told_apart += 1
    assert told_apart > 30


def test_sets_of_long_documents_that_share_a_passage_are_not_fetched(spark, monkeypatch):
    """Half of each text of a group is common, so prefixes meet; only near copies are asked for.

    All tokens count as equally frequent, as in a sketch that a large corpus has filled.
    """
    monkeypatch.setattr(prefix_join, "frequencies", lambda made: np.full(prefix_join.SKETCH, 300))
    asked = []
    fetch = ngram_join._fetch

    def counting(documents, wanted, extract):
        asked.extend(r.e for r in wanted.select("e").collect())
        return fetch(documents, wanted, extract)

    monkeypatch.setattr(ngram_join, "_fetch", counting)
    rng, rows = random.Random(4), []
    for group in range(6):
        passage = " ".join(f"p{group}x{k}" for k in range(400))
        for k in range(12):
            rows.append((100 * group + k, f"{passage} " + " ".join(f"o{rng.randrange(10**9)}" for _ in range(400))))
        words = rows[-1][1].split()
        words[50] = words[500] = "changed"
        rows.append((100 * group + 50, " ".join(words)))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = X.classes(rows)
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) == 72
    assert len(set(asked)) == 12


def test_keep_one_of_each_class(documents, table):
    kept = ngram_join.keep_one(documents)
    assert kept.columns == documents.columns
    want = X.classes(table)
    got = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == sorted(i for i in set(want) if want[i] == i)
    assert got.count(None) == 1


def test_keep_one_judges_rows_that_share_an_id_by_their_texts(spark):
    text = lambda k: " ".join(f"d{k}w{j}" for j in range(30))
    rows = [(0, text(k)) for k in range(20)] + [(0, text(3)), (5, text(4)), (6, text(50)), (6, text(51)), (7, text(51) + " more"), (8, "one"), (3, "one")]
    got = [tuple(r) for r in ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(got) == sorted([(0, text(k)) for k in range(20)] + [(6, text(50)), (6, text(51)), (3, "one")])


def test_line_dedup(documents, table):
    out = line_dedup.dedup_lines(documents)
    assert out.columns == documents.columns
    want = X.later_lines(table)
    got = out.collect()
    assert len(got) == len(table)
    for r in got:
        assert r.text == (want[r.doc_id] if r.doc_id is not None else table[[t[0] for t in table].index(None)][1])
        assert r.n_chars == (len(r.text) if r.text is not None else None)


def test_line_dedup_with_hot_words(spark, monkeypatch, table):
    monkeypatch.setattr(line_dedup, "COLD", 2)
    rows = [(k, f"alpha beta gamma delta epsilon zeta eta theta iota {'kappa' if k % 3 else k}") for k in range(30)]
    rows += [(100 + k, f"alpha own{k} other{k}") for k in range(10)]
    got = line_dedup.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = X.later_lines(rows)
    for r in got:
        assert r.kept_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
        assert (r.n_lines, r.n_removed) == (1, int(want[r.doc_id] == ""))


def test_substring_dedup(documents, table):
    got = substring_dedup.dedup_substrings(documents).collect()
    assert len(got) == len(table)
    want = X.repeated_words(table)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id]
        else:
            assert r.n_words > r.n_removed >= 0


def first_places(table: list[tuple], size: int) -> list[tuple]:
    """``(doc_id, kept)`` of every row: a window stays where its id and start are the smallest."""
    last, first, out = (1 << 63) - 1, {}, []
    rows = [(last if i is None else i, i, X.words_of(text)) for i, text in table]
    for doc, _, w in rows:
        for k in range(len(w) - size + 1):
            window = tuple(w[k:k + size])
            first[window] = min(first.get(window, (doc, k)), (doc, k))
    for doc, i, w in rows:
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k:k + size])] != (doc, k):
                gone.update(range(k, k + size))
        out.append((i, b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [20, 50, 7, 4])
def test_texts_that_share_an_id_or_have_none_stay_apart(spark, size):
    """Thousands of texts under one id and without an id, most of them without any repeat."""
    rng = random.Random(size)
    passages = [" ".join(f"p{j}x{k}" for k in range(60)) for j in range(5)]
    table = []
    for k in range(6_000):
        text = " ".join(f"{k}w{j}" for j in range(rng.randint(5, 40)))
        if k % 3 == 0:
            text = f"{text} {passages[rng.randrange(5)]} end"
        table.append((None if k % 2 else 7 if k % 4 else k, text))
    table += table[:40] * 3
    documents = spark.createDataFrame(table, "doc_id long, text string").repartition(6)
    got = substring_dedup.dedup_substrings(documents, size).collect()
    assert sorted(((r.doc_id, r.kept) for r in got), key=repr) == first_places(table, size)
    assert all(r.n_words - r.n_removed == len(r.kept.split()) for r in got)


@pytest.mark.parametrize("run", [
    ngram_join.near_duplicates, ngram_join.keep_one, line_dedup.dedup_lines, line_dedup.summary,
    substring_dedup.dedup_substrings,
])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], X.SCHEMA)).collect() == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (6, 5), (10, 3), (20, 19)] + [(100 + k, 101 + k) for k in range(20)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 4: 4, 5: 4, 6: 4, 19: 19, 20: 19} | {100 + k: 100 for k in range(21)}


def test_documents_that_lose_every_line_can_go(spark):
    table = [(1, "a b c\nd e f"), (2, "d e f\na b c"), (3, " \n"), (4, None), (5, "d e f\nnew words here"), (None, "a b c")]
    documents = spark.createDataFrame([(i, t, 9) for i, t in table], "doc_id long, text string, n_chars long")
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents, keep_emptied=False).collect()}
    assert kept == {1: table[0][1], 3: " \n", 4: None, 5: "new words here", None: "a b c"}
    assert {r.doc_id for r in line_dedup.dedup_lines(documents).collect()} == {1, 2, 3, 4, 5, None}


def test_lines_are_taken_out_of_a_text_once(spark):
    documents = spark.createDataFrame([(1, "a b c"), (2, "a b c\nd e")], "doc_id long, text string")
    plan = line_dedup.dedup_lines(documents, keep_emptied=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_one_id_on_many_texts(spark):
    """Lines of a hot id are looked up text by text; copies and near copies of one line settle one by one."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(20)]
    table = []
    for k in range(900):
        words = list(base)
        words[rng.randrange(20)] = f"x{k}"
        own = " ".join(f"{k}v{j}" for j in range(8))
        table.append((7 if k % 3 else k, f"{own}\n{' '.join(words)}"))
    documents = spark.createDataFrame(table * 2, "doc_id long, text string").repartition(5)
    got = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(documents).collect()}
    first = min(i for i, _ in table)
    assert got == {(i, t if i == first or not i else t.split("\n")[0]) for i, t in table}


def test_near_copies_make_few_pairs(spark):
    """A group of near copies in runs below the limit of hot ones: linear, and nothing is missed."""
    rng = random.Random(12)
    base, table = [f"w{k}" for k in range(30)], []
    for k in range(400):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(30)] = f"y{rng.randrange(60)}"
        table.append((k, " ".join(words)))
    documents = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    want = X.later_lines(table)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(documents).collect()} == want
    counts = prefix_join.frequencies(prefix_join.describe(documents, line_dedup.line_sets))
    rows = prefix_join.postings(documents, line_dedup.line_sets, counts, 80)
    found = prefix_join.candidates(rows, 80, line_dedup.COLD).filter(f"kind = {prefix_join.PAIR}").count()
    assert found < 400 * 80 < 400 * 399 // 2
