"""Every query of the catalog against its SQL in DuckDB, on the smallest tables."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as contract
from tidings.plans import catalog, oracle

TABLES = Path("/root/testdata/sf0.001")
QUERIES, SQL = catalog.queries(), oracle.oracle_sql()

# Two whole runs each; checked on the larger tables by the contract, here on request.
SLOW = {"daily_run", "run_summary"} if not os.environ.get("ALL_QUERIES") else set()


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    frame = QUERIES[name](spark, str(TABLES))
    columns = sorted(frame.columns)
    got = sorted(repr([row[c] for c in columns]) for row in frame.collect())
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(repr([row[names.index(c)] for c in columns]) for row in result.fetchall())
    assert got == want
