"""Every core query against its SQL on DuckDB, on the smallest data set."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from colloquy.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def canon(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    want = duck.sql(catalog.SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    left = Counter(tuple(canon(r[c]) for c in columns) for r in df.collect())
    right = Counter(tuple(canon(r[i]) for i in place) for r in want.fetchall())
    assert left == right


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() >= 0
