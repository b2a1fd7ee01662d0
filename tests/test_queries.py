"""Every query that has SQL against DuckDB on the same tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tidemark import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def tidy(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if frame[c].dtype.kind == "f":
            frame[c] = frame[c].round(6)
    return sorted(map(repr, (tuple(None if x is None or pd.isna(x) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r) for r in frame.astype(object).itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_duckdb(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert tidy(got) == tidy(want)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
