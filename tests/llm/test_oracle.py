"""Queries of the subpackage that SQL can express."""

from pathlib import Path

import duckdb
import pytest

from glossaflow.llm.queries import ORACLE, QUERIES

SMALL = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="needs the given tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    df = QUERIES[name](spark, str(SMALL))
    listed = ", ".join(f'"{c}"' for c in sorted(df.columns))
    got = sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect())))
    assert got == sorted(map(repr, con.sql(f"SELECT {listed} FROM ({ORACLE[name]})").fetchall()))
