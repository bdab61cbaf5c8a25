"""Queries that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from cueloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted((tuple(None if pd.isna(v) else v for v in r) for r in df[columns].values.tolist()), key=str)
    assert rows(got) == rows(want)
