"""Residue arithmetic, selection against brute force, awkward rows."""

import math
import random

import numpy as np
import pytest

from glossaflow.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int, parts string"


def brute(table: list[tuple]) -> list[tuple]:
    rows = []
    for vec_id, vector, label, *_ in table:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = int(math.fmod(label + 1, 10))
        rows.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    out = []
    order = lambda x: (-x[1], x[0] is None, x[0] or 0)
    for k, (anchor, a, label) in enumerate(rows):
        if anchor is None or anchor % 50:
            continue
        scored = [(i, sum(x * y for x, y in zip(a, b)), other) for j, (i, b, other) in enumerate(rows) if j != k]
        for positive, p, _ in sorted((x for x in scored if x[2] == label), key=order)[:5]:
            hard = [x for x in scored if x[2] != label and 50 * p <= 100 * x[1] <= 95 * p]
            for rank, (negative, n, _) in enumerate(sorted(hard, key=order)[:3], 1):
                out.append((anchor, positive, rank, negative, p, n))
    return sorted(out, key=repr)


def vectors(seed: int, n: int, dims: int, spread: float = 0.2) -> list[tuple]:
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    return [
        (k, [c + rng.gauss(0, spread) for c in rng.choice(centre)], rng.randrange(4), 0.0, 1, "x")
        for k in range(n)
    ]


@pytest.mark.parametrize("bound, dims", [(1, 3), (200_000, 64), (10**9, 300), (2**62, 1_000)])
def test_scores_are_exact(bound, dims):
    rng, primes = np.random.default_rng(dims), H.moduli(bound)
    assert math.prod(primes) > 2 * bound and all(p < 256 for p in primes)
    most = max(1, math.isqrt(bound // dims))
    a, b = rng.integers(-most, most + 1, (9, dims)), rng.integers(-most, most + 1, (7, dims))
    a[0], b[0] = most, -most
    got = H.scores(H.residues(a, primes), H.residues(b, primes), primes)
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    assert got.tolist() == want


def test_tops_keep_the_best_of_any_order():
    rng, tops, offered = np.random.default_rng(1), H.Tops(4, 3), []
    for _ in range(6):
        at, score, ids = rng.integers(0, 4, 20), rng.integers(-2, 3, 20), rng.integers(0, 50, 20)
        null = ids % 9 == 0
        tops.add(at, score, ids, null)
        offered += zip(at.tolist(), (-score).tolist(), null.tolist(), ids.tolist())
    for k in range(4):
        best = sorted(x for x in offered if x[0] == k)[:3]
        assert [-s for s in tops.score[k].tolist()] == [x[1] for x in best]
        assert tops.null[k].tolist() == [x[2] for x in best]
        assert [i for i, n in zip(tops.id[k].tolist(), tops.null[k]) if not n] == [x[3] for x in best if not x[2]]


@pytest.mark.parametrize("stripe, block", [(1 << 20, 64 << 20), (64, 1_000)])
def test_equals_brute_force(spark, monkeypatch, stripe, block):
    monkeypatch.setattr(H, "STRIPE_ROWS", stripe)
    monkeypatch.setattr(H, "ANCHOR_BYTES", block)
    monkeypatch.setattr(H, "TILE", 256)
    table = vectors(2, 300, 6)
    table += [table[50]] * 3 + [table[7]] * 40 + [(50, table[51][1], 2, 0.0, 1, "x")]
    table += [(400, None, 1, 0.0, 1, ""), (450, [1.0, None], 1, 0.0, 1, ""), (500, [float("nan")] * 6, 1, 0.0, 1, ""),
              (550, [float("inf")] * 6, 1, 0.0, 1, ""), (600, table[3][1], None, 0.0, 1, ""), (650, [], 1, 0.0, 1, ""),
              (700, [2.0], 1, 0.0, 1, ""), (-50, table[4][1], -5, 0.0, 1, ""), (-7, table[4][1], -1, 0.0, 1, "")]
    table += [(None, v, label, 0.0, 1, "x") for _, v, label, *_ in table[:9]]
    df = spark.createDataFrame(table, SCHEMA).repartition(5)
    got = H.mine(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(table)


def test_one_vector_on_a_third_of_all_rows(spark):
    table = vectors(3, 400, 4)
    table += [(1_000 + k, table[1][1], k % 3, 0.0, 1, "x") for k in range(300)]
    assert sorted(map(tuple, H.mine(spark.createDataFrame(table, SCHEMA)).collect()), key=repr) == brute(table)


def test_nothing_to_do(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert H.mine(empty).collect() == []
    assert H.mine(spark.createDataFrame([(1, [1.0], 1, 0.0, 1, "")], SCHEMA)).collect() == []
    assert H.mine(spark.createDataFrame([(50, [], 1, 0.0, 1, ""), (51, [], 1, 0.0, 1, ""), (52, [], 2, 0.0, 1, "")], SCHEMA)).collect()


def test_scores_beyond_64_bits_stop(spark):
    with pytest.raises(ValueError, match="64 bits"):
        H.mine(spark.createDataFrame([(50, [1e30], 1, 0.0, 1, "")], SCHEMA))
