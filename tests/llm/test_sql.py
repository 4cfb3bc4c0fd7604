"""Queries of the subpackage against their SQL on DuckDB, on the smallest data set, and those without SQL against what must hold."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from colloquy.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, duck, name):
    df, want = queries.QUERIES[name](spark, DATA), duck.sql(queries.SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[i] for i in place) for r in want.fetchall())


def test_containers_hold_every_document_once(spark):
    sizes = {r.doc_id: len(r.ids) for r in queries.p8_ids(spark, DATA).collect()}
    got = queries.p9_pack(spark, DATA).collect()
    used, whole = Counter(), Counter()
    for r in got:
        used[r.container] += r.n_tokens
        whole[r.doc_id] += r.n_tokens
    assert whole == {k: n for k, n in sizes.items() if n} and max(used.values()) <= 2048
    pieces = Counter(r.doc_id for r in got)
    assert all(k == 1 or sizes[d] > 2048 for d, k in pieces.items())


def test_dialogues_keep_all_limits(spark):
    used = {}
    for r in queries.p9_dialogues(spark, DATA).collect():
        a = used.setdefault(r.container, [0, 0, 0])
        a[0], a[1], a[2] = a[0] + r.n_tokens, a[1] + 1, a[2] + r.n_loss
    assert all(t <= 2048 and s <= 8 and n <= 1024 for t, s, n in used.values())


def test_mix_shares_and_turns(spark):
    size = Counter()
    for r in queries.p7_mix(spark, DATA).collect():
        size[r.source] += r.size
    assert {r.source: r.size for r in queries.p7_shares(spark, DATA).collect() if r.size} == dict(size)
    assert queries.p5_documents(spark, DATA).where("n_words < 1 or last_line < first_line or speaker not in (0, 1)").count() == 0
