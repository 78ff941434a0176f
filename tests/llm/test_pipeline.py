import __spark_entry__
import corpus_pipeline as C
from glossaflow.llm import decontaminate
from glossaflow.llm.tables import keep
from llm import fixtures as X

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in C.STAGES[:-1]:
        after, _ = keep(stage(spark, before, SF), name)
        assert after.columns == columns
        ids, kept = {r.doc_id for r in before.collect()}, {r.doc_id for r in after.collect()}
        assert kept <= ids
        if name == "ngram_jaccard_join":
            want = X.classes([(r.doc_id, r.text) for r in before.collect()])
            assert kept == {i for i in ids if want[i] == i}
        if name == "line_dedup":
            texts = {r.doc_id: r.text for r in before.collect()}
            want = X.later_lines(list(texts.items()))
            emptied = {i for i, t in want.items() if X.words_of(texts[i]) and not X.words_of(t)}
            assert kept == ids - emptied
            assert {r.doc_id: r.text for r in after.collect()} == {i: t for i, t in want.items() if i not in emptied}
        before = after
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.contaminated(before, benchmark).count() == 0
    packed = C.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in before.collect()}


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
