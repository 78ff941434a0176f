"""Registered queries agree with their SQL, and their plans have the wanted shape."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from glossaflow.operators import metrics as M
from glossaflow.operators import rows as O
from workload import views as V
from workload.oracle import ORACLE
from workload.queries import QUERIES

SMALL = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    return con


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1


def test_every_query_has_sql():
    """Those of the optional subpackage are tested beside it."""
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLE) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = entry_points.queries()[name](spark, str(SMALL))
    cols = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(*cols).collect())))
    listed = ", ".join(f'"{c}"' for c in cols)
    want = db.sql(f"SELECT {listed} FROM ({entry_points.oracle_sql()[name]})").fetchall()
    assert got == sorted(map(repr, want))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("metric", [M.corpus_chrf, M.corpus_bleu, M.hallucination_coverage])
def test_metrics_take_one_pass(spark, metric):
    text = plan(metric(O.valid_predictions(V.pairs(spark, str(SMALL))), "system"))
    assert text.count("ArrowEvalPython") == 1
    assert text.count("Exchange") == 1 and text.count("FileScan") == 1
    assert "PushedFilters: [EqualNullSafe(status,ok), IsNotNull(prediction)]" in text
    assert "ReadSchema: struct<system:string,reference:string,status:string,prediction:string>" in text


def test_filter_on_counts_does_not_count_twice(spark):
    rows = M.with_stats(V.pairs(spark, str(SMALL)), order=0)
    assert plan(rows.filter("st.pred_tokens > 0").select("id", "st.matched")).count("ArrowEvalPython") == 1


def test_relational_overlap_shuffles_by_key_only(spark):
    text = plan(M.token_overlap_relational(V.pairs(spark, str(SMALL)), "id"))
    assert text.count("Exchange hashpartitioning(id") == 1 and text.count("Exchange") == 1


def test_corpus_index_of_one_file_needs_no_shuffle(spark):
    text = plan(entry_points.queries()["corpus_scan"](spark, str(SMALL)))
    assert "Exchange" not in text and "Join" not in text
