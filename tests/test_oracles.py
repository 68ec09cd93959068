"""Every query with SQL against DuckDB over the smallest tables; every other one must run."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if QUERIES[n].__module__.startswith("skeinwork.plans")))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*cols).collect())
    if name in ORACLES:
        want = duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({ORACLES[name]})").fetchall()
        assert got == Counter(tuple(map(plain, r)) for r in want)


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
