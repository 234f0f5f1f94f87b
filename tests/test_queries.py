"""Every query against its SQL on the smallest tables, where these exist."""

import glob
import os

import duckdb
import pytest

from orbitframe.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_same_rows_as_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    rel = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    want = [tuple(r) for r in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)
