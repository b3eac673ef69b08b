"""Every registered query against its oracle on the smallest tables."""

import math
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from turnout.sources.adapters import BASE

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="test tables not present")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for b in BASE:
        con.execute(f"create view {b} as select * from '{FOLDER}/{b}.parquet'")
    return con


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9) + 0.0)
    return repr(x) if isinstance(x, bool) or x is None else f"{type(x).__name__}:{x}"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert sorted(tuple(cell(r[names.index(c)]) for c in cols) for r in cur.fetchall()) == got
