"""Every raster query against the SQL that it must equal, or its own invariants."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from pixelmill.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "nan"
        return repr(round(float(v), 9)) if isinstance(v, float) else str(v)

    out = pd.DataFrame({c: df[c].map(cell) for c in sorted(df.columns)})
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(plain(got), plain(want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    for c in ("mismatches",):
        if c in got:
            assert (got[c] == 0).all()
