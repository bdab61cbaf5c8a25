"""Every query with SQL against DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from cueloom.plans.registry import ORACLES, QUERIES

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in SF.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def rows(frame, columns):
    def norm(v):
        if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        try:
            return round(float(v), 6)
        except (TypeError, ValueError):
            return str(v)

    return sorted([tuple(map(norm, r)) for r in frame[columns].values.tolist()], key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, str(SF)).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(SF)).toPandas().columns.size > 0
