"""The queries that SQL can express, against DuckDB over the smallest tables."""

import duckdb
import pytest

from promoscope.llm.oracle import ORACLE
from promoscope.llm.queries import QUERIES

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE_DIR}/{t}.parquet')")
    cur = con.execute(ORACLE[name])
    columns = [c[0] for c in cur.description]
    want = sorted(cur.fetchall())
    df = QUERIES[name](spark, SMOKE_DIR)
    assert sorted(df.columns) == sorted(columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()))
    assert got == want
