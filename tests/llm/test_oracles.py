"""Operators that SQL can express, against their SQL on the smallest tables."""

import glob
from pathlib import Path

import duckdb
import pytest

from fathom.llm.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {Path(p).stem} as select * from '{p}'")
    got, rel = QUERIES[name](spark, DATA), con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(rel.columns)
    want = sorted(repr([dict(zip(rel.columns, r, strict=True))[c] for c in columns]) for r in rel.fetchall())
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == want
