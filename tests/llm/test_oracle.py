"""Each query that SQL can express equals its DuckDB oracle; the others have brute-force tests."""

import duckdb
import pytest

from tools.oracle_check import TABLES, digest
from twinlake.llm.registry import ORACLE, QUERIES

from ..conftest import SF_SMALL


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = QUERIES[key](spark, SF_SMALL)
    rows, rel = [tuple(r) for r in df.collect()], con.sql(ORACLE[key])
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns) and len(rows) == len(want)
    assert digest(df.columns, rows)[0] == digest(rel.columns, want)[0]
