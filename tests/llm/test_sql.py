"""The llm queries that SQL can express against their SQL, at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest

from emberleaf.llm import queries
from tests.test_registry import rows


@pytest.mark.parametrize("name", queries.ORACLE)
def test_query(spark, sf, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.execute(f"create view {table} as select * from read_parquet('{sf}/{table}.parquet')")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), db.sql(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
