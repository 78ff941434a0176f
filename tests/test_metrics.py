"""Metrics against plain restatements of their formulas."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossaflow.functions import pair_stats as K
from glossaflow.functions import scores as S
from glossaflow.operators import metrics as M
from glossaflow.operators import rows as O
from glossaflow.plans import reports

TOKEN = re.compile("[\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff]|[A-Za-z0-9]+")
SCHEMA = "id bigint, system string, prediction string, reference string, status string"


def grams(text, n):
    chars = [c for c in text if not c.isspace()]
    return Counter(tuple(chars[i:i + n]) for i in range(len(chars) - n + 1))


def counts(pred, ref, order=6):
    out = {}
    for n in range(1, order + 1):
        h, r = grams(pred, n), grams(ref, n)
        out[n] = (sum(h.values()), sum(r.values()), sum((h & r).values()))
    return out


def random_pairs(n=200, seed=3):
    rng = random.Random(seed)
    letters = "ab c\n天气很好é　😀ſAB12,."
    long = ["abcdefghij", "abcdefghija", "abcdefghijab", "0123456789", "zZ9", "豈", "㐀"]
    one = lambda: "".join(rng.choices([*letters, *long], k=rng.choice([0, 1, 2, 5, 30, 200])))
    return [(i, f"s{i % 3}", one(), one(), "ok") for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def chrf_by_hand(rows, beta=2.0):
    total = {n: [0, 0, 0] for n in range(1, 7)}
    for pred, ref in rows:
        for n, (h, r, m) in counts(pred, ref).items():
            total[n][0] += h if r else 0
            total[n][1] += r
            total[n][2] += m
    used = [t for t in total.values() if t[0] and t[1]]
    if not used:
        return 0.0
    p = sum(m / h for h, _, m in used) / len(used)
    r = sum(m / r for _, r, m in used) / len(used)
    return 100 * (1 + beta**2) * p * r / (beta**2 * p + r) if p + r else 0.0


def bleu_by_hand(rows):
    total = {n: [0, 0, 0] for n in range(1, 5)}
    for pred, ref in rows:
        for n, c in counts(pred, ref, 4).items():
            for k in range(3):
                total[n][k] += c[k]
    hyp_len, ref_len = total[1][0], total[1][1]
    if not any(t[2] for t in total.values()) or not all(t[0] for t in total.values()):
        return 0.0
    smooth, logs = 1.0, 0.0
    for h, _, m in total.values():
        if m == 0:
            smooth *= 2
        logs += math.log(m / h if m else 1 / (smooth * h))
    bp = 1.0 if hyp_len >= ref_len else math.exp(1 - ref_len / hyp_len)
    return 100 * bp * math.exp(logs / 4)


@pytest.mark.parametrize("block", [1, 50, 1 << 15])
def test_kernel_counts(block, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_BYTES", block)
    rows = random_pairs()
    hyps, refs = [r[2] for r in rows], [r[3] for r in rows]
    at = 0
    for a, b in K._blocks(pa.array(hyps), pa.array(refs)):
        grams_out = K._ngram_block(hyps[a:b], refs[a:b], 6)
        tokens_out = K._token_block(hyps[a:b], refs[a:b])
        for i in range(a, b):
            want = counts(hyps[i], refs[i])
            assert [tuple(grams_out[:, n - 1, i - a]) for n in range(1, 7)] == list(want.values())
            p, r = TOKEN.findall(hyps[i]), TOKEN.findall(refs[i])
            assert list(tokens_out[:, i - a]) == [len(p), len(r), sum((Counter(p) & Counter(r)).values())]
        assert a == at
        at = b
    assert at == len(rows)


def test_null_and_no_texts(spark):
    df = spark.createDataFrame([(None, "ab"), ("ab", None), (None, None)], "prediction string, reference string")
    got = sorted((r.st.h1, r.st.r1, r.st.m1, r.st.pred_tokens, r.st.ref_tokens, r.st.matched)
                 for r in M.with_stats(df).collect())
    assert got == [(0, 0, 0, 0, 0, 0), (0, 2, 0, 0, 1, 0), (2, 0, 0, 1, 0, 0)]
    assert M.with_stats(df.filter("prediction = 'x'")).count() == 0
    assert list(K._blocks(pa.array([], pa.string()), pa.array([], pa.string()))) in ([], [(0, 0)])


def test_kernel_ranks_wide_alphabets():
    rng = random.Random(1)
    wide = ["".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(3_000)) for _ in range(4)]
    near = [t[:1_000] + t[1_500:] for t in wide]
    out = K._ngram_block(near, wide, 6)
    for i in range(4):
        want = counts(near[i], wide[i])
        assert [tuple(out[:, n - 1, i]) for n in range(1, 7)] == list(want.values())


def test_kernel_and_relational_tokens_agree(spark):
    df = frame(spark, random_pairs())
    rel = {r.id: (r.pred_tokens, r.ref_tokens, r.matched)
           for r in M.token_overlap_relational(df, "id").collect()}
    own = M.with_stats(df, order=0).select("id", "st.*").filter("pred_tokens > 0 AND ref_tokens > 0")
    assert {r.id: (r.pred_tokens, r.ref_tokens, r.matched) for r in own.collect()} == rel
    one = frame(spark, [(0, "s", "a a b", "a b b", "ok")])
    assert M.with_stats(one, order=0).first().st.matched == 2


def test_corpus_scores(spark):
    rows = random_pairs()
    df = frame(spark, rows)
    chrf = {r.system: r.chrF for r in M.corpus_chrf(df, "system").collect()}
    chrf1 = {r.system: r.chrF for r in M.corpus_chrf(df, "system", beta=1.0).collect()}
    bleu = {r.system: r.bleu for r in M.corpus_bleu(df, "system").collect()}
    for s in chrf:
        own = [(r[2], r[3]) for r in rows if r[1] == s]
        assert chrf[s] == pytest.approx(chrf_by_hand(own), abs=1e-4)
        assert chrf1[s] == pytest.approx(chrf_by_hand(own, 1.0), abs=1e-4)
        assert bleu[s] == pytest.approx(bleu_by_hand(own), abs=1e-4)


@pytest.mark.parametrize("pair", [
    ("abcd", "abxd"), ("ab", "abcdef"), ("xyzw", "abcd"), ("abcdefgh", "abzzefzz"), ("a", "a")])
def test_bleu_edges(spark, pair):
    df = frame(spark, [(0, "s", *pair, "ok")])
    assert M.corpus_bleu(df).first().bleu == pytest.approx(bleu_by_hand([pair]), abs=1e-4)
    assert M.corpus_chrf(df).first().chrF == pytest.approx(chrf_by_hand([pair]), abs=1e-4)


def test_printed_bleu(spark):
    """Published figures: these precisions and lengths print as 39.95."""
    hyp = [15_459, 14_460, 13_461, 12_462]
    match = [round(h * p / 100) for h, p in zip(hyp, (65.0, 45.5, 34.3, 26.9))]
    lits = lambda xs: [F.lit(x).cast("bigint") for x in xs]
    terms = S.bleu_terms(lits(hyp), lits([15_718, 14_719, 13_720, 12_721]), lits(match))
    ties = [(12.25, 1), (1.005, 2), (0.0625, 3), (12.35, 1), (0.125, 2), (1234.5, 0), (0.0, 1)]
    got = spark.range(1).select(*[S.fixed(F.lit(x), n).alias(str(k)) for k, (x, n) in enumerate(ties)]).first()
    assert list(got) == [f"{x:.{n}f}" for x, n in ties]
    text = spark.range(1).select(S.bleu_text(terms).alias("t")).first().t
    assert text.startswith("BLEU = 39.9") and text.endswith(
        "65.0/45.5/34.3/26.9 (BP = 0.983 ratio = 0.984 hyp_len = 15459 ref_len = 15718)")


def test_entities(spark):
    df = frame(spark, [
        (0, "s", "Tom", "Tom met Bob", "ok"), (1, "s", "1 2 3", "1 2 3", "ok"), (2, "s", "x", "y", "ok")])
    row = M.entity_accuracy(df).first()
    assert (row.total_entities, row.retained_entities, row.ETA) == (5, 4, 80.0)
    assert M.entity_retention(df).first().ERR == 75.0


def test_empty_input(spark):
    df = frame(spark, [])
    row = M.hallucination_coverage(df).first()
    assert (row.hallucination_rate, row.content_coverage) == (None, None)
    assert M.entity_accuracy(df).first().ETA == 0.0
    assert M.entity_retention(df).first().ERR == 0.0


def test_perfect_predictions(spark):
    rows = [(i, "s", f"Tom has {i} 天气很好 books", f"Tom has {i} 天气很好 books", "ok") for i in range(20)]
    report = reports.intrinsic_report(frame(spark, rows)).first()
    assert (report.valid, report.chrF, report.hallucination_rate, report.content_coverage) == (20, 100, 0, 100)
    entity = reports.entity_report(frame(spark, rows)).first()
    assert (entity.ETA, entity.ERR, entity.COMET) == (100.0, 100.0, None)
    assert entity.BLEU.startswith("BLEU = 100.00 100.0/100.0/100.0/100.0 (BP = 1.000")


def test_entity_report_counts_invalid_rows(spark):
    rows = [(0, "s", "Tom", "Tom", "ok"), (1, "s", " ", "Bob", "ok"), (2, "s", "Bob", "Bob", "OOM"),
            (3, "s", None, "Bob", "ok"), (4, "s", "x", "y", None)]
    row = reports.entity_report(frame(spark, rows)).first()
    assert (row.total, row.valid, row.ETA) == (5, 1, 100.0)
    assert O.valid_predictions(frame(spark, rows)).count() == 1


def test_denominators_differ(spark):
    """chrF takes every valid row, the token rates only rows with tokens."""
    rows = [(0, "s", "abc", "abc", "ok"), (1, "s", "，。", "，。!", "ok")]
    report = reports.intrinsic_report(frame(spark, rows)).first()
    assert report.valid == 2 and report.hallucination_rate == 0.0
    assert report.chrF == pytest.approx(chrf_by_hand([(r[2], r[3]) for r in rows]), abs=1e-4)


def test_merged_chunks_equal_one_file(spark):
    rows = [r for r in random_pairs() if r[2].strip() and r[3].strip()]
    df = frame(spark, rows)
    whole = df.select(F.col("system").alias("model"), F.col("prediction").alias("pred_zh"),
                      F.col("reference").alias("ref_zh"), F.lit(None).cast("string").alias("pred"),
                      F.lit(None).cast("string").alias("ref"))
    a = whole.filter("ascii(pred_zh) % 2 = 0").drop("pred", "ref")
    b = whole.filter("ascii(pred_zh) % 2 = 1").select("model", F.col("pred_zh").alias("pred"), F.col("ref_zh").alias("ref"))
    one = sorted(reports.system_report(whole).collect())
    assert sorted(reports.system_report(O.merge_chunks([a, b])).collect()) == one
    named = reports.system_report(whole.withColumn("file", F.lit("f1"))).collect()
    assert all(r.files == ["f1"] for r in named)


def test_status_and_latency(spark):
    df = spark.createDataFrame(
        [("ok", "a", 0.5), ("ok", " ", 1.5), ("ERR:x:y", "", 9.0), ("OOM", "", 2.0)],
        "status string, prediction string, latency_s double")
    run = M.run_summary(df).first()
    assert (run.total, run.ok, run.valid) == (4, 2, 1)
    lat = M.latency_summary(df).first()
    assert (lat.ok, lat.mean_s, lat.min_s, lat.max_s) == (2, 1.0, 0.5, 1.5)
    assert {(r.outcome, r.n) for r in M.status_counts(df).collect()} == {("ok", 2), ("ERR", 1), ("OOM", 1)}
