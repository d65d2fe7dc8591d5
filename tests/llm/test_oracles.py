"""The queries that SQL can answer, against DuckDB."""

import duckdb
import pytest

from flowloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, folder, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    want = c.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, folder)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
