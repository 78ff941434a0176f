"""The audit against a plain count of every order."""

import re
from itertools import permutations

from glossaflow.llm import filter_audit as A
from llm import fixtures as X

LABELS = "doc_id long, quality int, toxic int, part string, filter string"


def failures(table: list[tuple]) -> list[set]:
    first: dict = {}
    for i, text, *_ in table:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    out = []
    for i, text, *_ in table:
        text, w = text or "", X.words_of(text)
        out.append({
            name for name, failed in {
                "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w),
                "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and first[text] < i,
            }.items() if failed
        })
    return out


def brute(table: list[tuple], labels: list[tuple]) -> set[tuple]:
    fails = failures(table)
    good, toxic = {r[0] for r in labels if r[1] == 1}, {r[0] for r in labels if r[2] == 1}
    out = set()
    for part in {r[3] or "" for r in table}:
        rows = [(r[0], f) for r, f in zip(table, fails) if (r[3] or "") == part]
        steps, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, name in enumerate(order, 1):
                gone = [r for r in left if name in r[1]]
                redundant = sum(name in f for _, f in rows) - len(gone)
                left = [r for r in left if name not in r[1]]
                shapley[name] += len(gone)
                steps.append((
                    part, "".join(order), step, len(left), len(gone), redundant, sum(f == {name} for _, f in rows),
                    sum(i in good for i, _ in gone if i is not None), sum(i in toxic for i, _ in gone if i is not None),
                ))
        out |= {(*s, shapley[s[1][s[2] - 1]]) for s in steps}
    return out


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def run(spark, table, labels) -> list[tuple]:
    documents = spark.createDataFrame(table, X.SCHEMA).repartition(4)
    return [tuple(r[c] for c in COLUMNS) for r in A.audit(documents, spark.createDataFrame(labels, LABELS)).collect()]


def test_equals_plain_count(spark):
    table, sources = X.rows(n=90), ["s0", "s0", "s0", "s1", "s2", None]
    table = [(i, t, lang, sources[k % 6], *rest) for k, (i, t, lang, _, *rest) in enumerate(table)]
    loud = "LOUD # " + " ".join(f"word{k}" for k in range(80))
    table += [(9_000 + k, loud, "en", "s1", 1, None, None, None) for k in range(5)]
    table += [(9_001, "AB " * 60, "en", "s0", 1, None, None, None), (9_001, "x \x0b\x0c" * 70, "en", "s0", 1, None, None, None)]
    table += [(None, loud, "en", "s1", 1, None, None, None), (None, None, None, None, 1, None, None, None)]
    labels = [(r[0], k % 2, k % 3 == 0, "p", "f") for k, r in enumerate(table) if k % 4]
    labels = [(i, q, int(t), a, b) for i, q, t, a, b in labels] + [(None, 1, 1, "", ""), (9_001, 1, None, "", ""), (9_001, None, 0, "", "")]
    got = run(spark, table, labels)
    assert len(got) == 600 * 4 and set(got) == brute(table, labels)


def test_one_text_and_one_id_on_many_rows(spark):
    table = [(5, "same text", "en", "s0", 1, None, None, None)] * 300 + [(k, "same text", "en", "s0", 1, None, None, None) for k in range(300)]
    labels = [(5, 1, 1, "", "")] * 4
    assert set(run(spark, table, labels)) == brute(table, labels)


def test_clean_and_empty_tables(spark):
    clean = [(k, " ".join(f"w{k}x{j}" for j in range(60)), "en", "s0", 1, None, None, None) for k in range(4)]
    got = run(spark, clean, [(1, 1, 0, "", "")])
    assert {r[3:] for r in got} == {(4, 0, 0, 0, 0, 0, 0)} and len(got) == 600
    assert run(spark, [], []) == []


def test_very_long_text(spark):
    table = [(1, "word " * 400_000, "en", "s", 1, None, None, None), (2, "X" * 1_000_000, "en", "s", 1, None, None, None)]
    assert set(run(spark, table, [])) == brute(table, [])


def test_no_table_goes_through_the_driver(spark, monkeypatch):
    """Not even at these sizes: Spark judges by compressed bytes, the driver holds rows."""
    plans = []

    def ran(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    keep = A.keep
    monkeypatch.setattr(A, "keep", lambda df, *how: keep(ran(df), *how))
    table = [(k, "A # few words" if k % 3 else f"text {k}", "en", f"s{k % 4}", 1, None, None, None) for k in range(60)]
    documents, labels = spark.createDataFrame(table, X.SCHEMA), spark.createDataFrame([(3, 1, 0, "", "")], LABELS)
    ran(A.audit(documents, labels))
    assert sum("SortMergeJoin" in p for p in plans) >= 5 and not [p for p in plans if "Broadcast" in p]


def test_rows_of_one_text_or_id_can_be_split(spark, monkeypatch):
    """Spark splits a hot key only where both sides of a join are exchanges."""
    seen = {}
    keep = A.keep
    monkeypatch.setattr(A, "keep", lambda df, label, *by: seen.update({label: df}) or keep(df, label, *by))
    table = [(k % 50, "same text", "en", "s0", 1, None, None, None) for k in range(4_000)]
    documents, labels = spark.createDataFrame(table, X.SCHEMA).repartition(8), spark.createDataFrame([(k, 1, 0, "", "") for k in range(50)], LABELS)
    tight = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    monkeypatch.setattr(A, "drop", lambda *_: None)
    A.audit(documents, labels)
    try:
        for name, value in tight.items():
            spark.conf.set(name, value)
        df = seen["failing"].select("*")
        df.collect()
        splits = df._jdf.queryExecution().executedPlan().toString().count("skew=true")
    finally:
        for name in tight:
            spark.conf.unset(name)
    assert splits
