"""Every query against its SQL on the smallest tables."""

import glob
import math
from pathlib import Path

import duckdb
import pytest

from fathom.plans import builds, files, library  # noqa: F401  they add their queries to the catalog
from fathom.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {Path(p).stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return int(v) if isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    rel = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(rel.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    want = sorted(repr([plain(dict(zip(rel.columns, r, strict=True))[c]) for c in columns]) for r in rel.fetchall())
    assert rows == want
