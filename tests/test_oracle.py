"""Every registered query against its DuckDB oracle SQL at sf0.001 (the driver's check, smaller)."""

import os
import sys

import duckdb
import pytest

from conftest import SMOKE_DIR

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))
from check_oracle import TABLES, digest  # noqa: E402

from __spark_entry__ import entry  # noqa: E402
from promoscope.plans.catalog import oracle_sql, queries  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SMOKE_DIR}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0
    assert "nps" in df.columns


def test_every_query_has_an_oracle():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_oracle(spark, duck, name):
    df = queries()[name](spark, SMOKE_DIR)
    cols = df.columns
    got = [tuple(r) for r in df.collect()]
    sql = oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    cur = duck.execute(sql)
    dcols = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(cols) == sorted(dcols)
    assert len(got) == len(want)
    assert digest(got, cols) == digest(want, dcols)
