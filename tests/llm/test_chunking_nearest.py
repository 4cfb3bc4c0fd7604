import random

import numpy as np

from colloquy.llm.chunking import RangeMaximum, cut_items, quiet_ends
from colloquy.llm.nearest import match_nearest


def test_range_maximum():
    r = random.Random(1)
    v = np.array([r.randrange(5) for _ in range(60)])
    t = RangeMaximum(v)
    for lo in range(60):
        for hi in range(lo + 1, 61):
            assert t.best(lo, hi) == max(range(lo, hi), key=lambda i: (v[i], i))


def plain_pieces(total, marks, limit, overlap):
    out, start = [], 0
    while total > limit:
        if total - start <= limit:
            out.append((start, total))
            break
        best = [(s, p) for p, s in marks if start + overlap < p <= start + limit]
        end = max(best)[1] if best else start + limit
        out.append((start, end))
        start = end - overlap
    return out


def test_pieces(spark):
    r = random.Random(2)
    totals = {f"i{k}": r.randrange(1, 3000) for k in range(40)} | {"exact": 100, "none": None, "zero": 0, "neg": -5, "bare": 777}
    marks = {i: sorted({(r.randrange(0, 3000), float(r.randrange(3))) for _ in range(r.randrange(0, 120))}) for i in totals if i != "bare"}
    marks["unknown"] = [(5, 1.0)]
    items = spark.createDataFrame([(i, t, "x") for i, t in totals.items()] + [("i1", totals["i1"], "x"), (None, 500, "x")], "item string, total int, at string")
    bounds = spark.createDataFrame([(i, p, s) for i, m in marks.items() for p, s in m] + [("i1", None, 1.0), ("i1", -4, 9.0)], "item string, at int, strength double")
    got = {}
    for x in cut_items(items.select("item", "total"), bounds, "item", "total", "at", "strength", 100, 10).orderBy("item", "piece_no").collect():
        got.setdefault(x.item, []).append((x.start, x.end))
    # of marks at one place the strongest counts
    want = {i: plain_pieces(t, marks.get(i, []), 100, 10) for i, t in totals.items() if t and t > 100}
    assert got == want
    assert cut_items(items.select("item", "total").where("false"), bounds, "item", "total", "at", "strength", 100, 10).count() == 0


def test_streams_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_pieces(spark)
        test_nearest(spark)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_quiet_ends(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), s, s + r.randrange(-2, 40)) for s in (r.randrange(-50, 1500) for _ in range(300))] + [("a", None, 4), ("a", 4, None), (None, 1, 2)]
    df = spark.createDataFrame(rows, "item string, s int, e int")
    ok = [x for x in rows if None not in x and x[2] > x[1]]
    want = sorted({(i, e) for i, _, e in ok if not any(j == i and s < e < f for j, s, f in ok)})
    assert sorted(tuple(x) for x in quiet_ends(df, "item", "s", "e", shard=100).collect()) == want


def test_nearest(spark):
    r = random.Random(4)
    left = [(r.choice("ab"), r.randrange(2), k, r.randrange(-3000, 3000)) for k in range(300)]
    right = [(r.choice("ab"), r.randrange(2), 1000 + k, r.randrange(-3000, 3000)) for k in range(250)]
    right += [(x[0], x[1], x[2] + 5000, x[3]) for x in right[:60]]  # ties of instant
    dirty_l = [*left, left[0], left[0], ("a", 0, 900, None), (None, 0, 901, 5), ("a", None, 902, 5), ("zz", 1, 903, 5)]
    dirty_r = [*right, right[0], ("a", 0, None, 5)]
    l = spark.createDataFrame([(*x, "q") for x in dirty_l], "conv string, who int, id int, at int, w string")
    q = spark.createDataFrame([(*x, "q") for x in dirty_r], "conv string, who int, seg int, mid int, side string")
    got = sorted(tuple(x) for x in match_nearest(l, q, ["conv", "who"], "id", "seg", "at", "mid", 40, window=100).collect())
    want = []
    for c, w, k, t in left:
        near = sorted((abs(t - m), s) for d, v, s, m in right if (d, v) == (c, w) and abs(t - m) <= 40)
        if near:
            want.append((k, near[0][1]))
    assert got == sorted(want)
    assert match_nearest(l.where("false"), q, ["conv", "who"], "id", "seg", "at", "mid", 40).count() == 0
    assert match_nearest(l, q.where("false"), ["conv", "who"], "id", "seg", "at", "mid", 40).count() == 0
