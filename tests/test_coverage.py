import random

from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.operators.coverage import SHARD, periods_and_gaps

SCHEMA = "k string, who int, s bigint, e bigint, kind string"


def brute(intervals):
    out = []
    by = {}
    for k, who, s, e in intervals:
        if k is not None and who is not None and s is not None and e is not None and e > s:
            by.setdefault((k, who), []).append((s, e))
    for key, iv in by.items():
        merged = []
        for s, e in sorted(iv):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(*key, "period", s, e) for s, e in merged] + [(*key, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out)


def run(spark, intervals):
    df = spark.createDataFrame([(*i, "x") for i in intervals], SCHEMA)
    return sorted(tuple(r) for r in periods_and_gaps(df, ["k", "who"], "s", "e").collect())


def test_edges_of_shards_nulls_ties_and_repeats(spark):
    data = [
        ("a", 0, 0, SHARD), ("a", 0, SHARD, 3 * SHARD), ("a", 0, 3 * SHARD, 3 * SHARD + 1), ("a", 0, 3 * SHARD + 5, 3 * SHARD + 6), ("a", 0, 0, SHARD),
        ("a", 1, 10, 10), ("a", 1, 12, 3), ("b", 1, -5, 7), ("b", 1, 9 * SHARD, 9 * SHARD + 2), (None, 0, 1, 2), ("c", None, 1, 2), ("d", 0, None, 4), ("d", 0, 3, None),
    ]
    assert run(spark, data) == brute(data)


def test_empty(spark):
    assert run(spark, []) == []


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10**6))
def test_random(spark_of, seed):
    r = random.Random(seed)
    data = []
    for _ in range(300):
        s = r.randrange(-SHARD, 6 * SHARD)
        data.append((r.choice("ab"), r.randrange(2), s, s + int(10 ** r.uniform(-0.5, 5.3))))
    assert run(spark_of, data) == brute(data)


def test_hot_entity(spark):
    data = [("hot", 0, 7 * i, 7 * i + (9 if i % 5 else 3)) for i in range(30_000)] + [("cold", 1, 1, 2)]
    assert run(spark, data) == brute(data)


def test_keys_that_are_never_null_over_several_batches(spark):
    from pyspark.sql import functions as F

    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, 3)
    try:
        x = spark.range(40).select(F.concat(F.lit("c"), F.col("id") % 7).alias("k"), F.lit(1).alias("who"), (F.col("id") * 5_000).alias("s"), (F.col("id") * 5_000 + 9_000).alias("e"))
        assert not x.schema["who"].nullable
        data = [(r.k, r.who, r.s, r.e) for r in x.collect()]
        assert sorted(tuple(r) for r in periods_and_gaps(x, ["k", "who"], "s", "e").collect()) == brute(data)
    finally:
        spark.conf.set(size, before)
