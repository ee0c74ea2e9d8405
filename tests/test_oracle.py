"""Each query of the core against its SQL, on the smallest data."""

import glob
import math
import os

import duckdb
import pytest

from scanloom.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = db.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    theirs = sorted(repr([plain(r[k]) for k in at]) for r in want.fetchall())
    assert ours == theirs


def test_every_sql_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
