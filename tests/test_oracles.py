"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from kbspark import plans

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(v):
    if isinstance(v, (list, tuple)) or getattr(v, "ndim", 0):
        return [plain(x) for x in v]
    if v is None or v is pd.NaT or (not isinstance(v, str) and pd.isna(v)):
        return None
    if isinstance(v, (str, bool)):
        return v
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return bool(v) if "bool" in type(v).__name__ else round(float(v), 6)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    got = plans.queries()[name](spark, FOLDER).toPandas()
    sql = plans.oracles().get(name)
    if not sql:
        assert len(got.columns)
        return
    want = duck.execute(sql).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(str([plain(x) for x in r]) for r in df[columns].itertuples(index=False, name=None))
    assert rows(got) == rows(want)
