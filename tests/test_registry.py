"""Every registered query of the engine's own operators against its SQL, at the smallest scale."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from emberleaf import registry


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def rows(df):
    cell = lambda x: "null" if pd.isna(x) else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(cell(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, sf, db, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name in registry.ORACLE:
        want = db.sql(registry.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) and not any(isinstance(x, float) and math.isnan(x) for x in got.iloc[0])
