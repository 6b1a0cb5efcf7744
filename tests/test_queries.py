"""Every query that has SQL gives the same rows as DuckDB on the same tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from corvane import plans

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{TABLES}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if pd.isna(x) else round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x) for x in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_same_rows(spark, duck, name):
    ours = plans.QUERIES[name](spark, TABLES).toPandas()
    theirs = duck.execute(plans.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) and rows(ours) == rows(theirs)
