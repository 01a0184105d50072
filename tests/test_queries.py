"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import datetime as dt
import glob
import os

import duckdb
import pytest

from memgrid.plans import catalog, registry
from memgrid.sources.logical import Tables

#: Queries that SQL does not express; their operators are tested one by one.
WITHOUT_SQL = {"deterministic_embed", "complete_linkage", "supersede_downgrade"}


def plain(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, con, name):
    df = catalog.QUERIES[name](Tables(spark, sf_dir))
    rows = sorted(repr(tuple(map(plain, r))) for r in df.collect())
    if name in WITHOUT_SQL:
        assert rows and name not in catalog.SQL
        return
    r = con.sql(catalog.SQL[name])
    at = [r.columns.index(c) for c in df.columns]
    assert sorted(r.columns) == sorted(df.columns)
    assert rows == sorted(repr(tuple(plain(x[k]) for k in at)) for x in r.fetchall())
