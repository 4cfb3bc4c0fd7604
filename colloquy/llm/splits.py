"""Splits that never part related records.

Links between records and what they share are united by a distributed union-find:
every task makes a forest of its own links and forests are merged level by level
into fewer tasks, at any number of links. Only where the forests of one merge can't be held
together do rounds of large-star and small-star contraction finish the work. Groups are then
given to splits largest first, each to the split furthest below its target.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.ranking import rank_within
from colloquy.tables import checkpointed

FOREST = "node string, root string"
SALTS = 64  # parts over which the neighbours of one node are spread


def _forest_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (node, root) of one task -> a forest of the same components, each node under the smallest of its tree."""
    links: pa.Table | None = None
    pending: list[pa.RecordBatch] = []

    def reduce(parts: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(parts)
        n = t.num_rows
        both = pa.chunked_array([*t.column(0).chunks, *t.column(1).chunks], pa.string()).combine_chunks().dictionary_encode()
        names = both.dictionary
        order = np.argsort(np.array(names.to_pylist(), dtype=object), kind="stable") if len(names) else np.zeros(0, np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ends = place[np.asarray(both.indices)]
        a, b = ends[:n], ends[n:]
        root = np.arange(len(order))
        while True:  # hook the larger root under the smaller one, then halve all paths
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(ra[apart], rb[apart]), np.minimum(ra[apart], rb[apart]))
            while (root[root] != root).any():
                root = root[root]
        child = np.flatnonzero(root != np.arange(len(root)))
        take = lambda x: names.take(pa.array(order[x])).cast(pa.string())
        return pa.table({"node": take(child), "root": take(root[child])})

    held = 0
    for batch in batches:
        pending.append(batch)
        held += batch.num_rows
        if held > 500_000:
            links = reduce([*([links] if links is not None else []), pa.Table.from_batches(pending)])
            pending, held = [], 0
    if pending:
        links = reduce([*([links] if links is not None else []), pa.Table.from_batches(pending)])
    if links is not None:
        yield from links.to_batches(max_chunksize=50_000)


def _held(forest: DataFrame) -> int:
    """The most links that one task of ``forest`` holds."""
    per = forest.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()
    return per[0] or 0


def components(links: DataFrame, per_task: int = 2_000_000, fan_in: int = 8) -> DataFrame:
    """(node, root) of every node of ``links`` (its first two columns, strings); the root is the smallest node of the component.

    Rows with a null link nothing. Every task makes a forest of its links; then, level by level and whatever their
    number, ``fan_in`` neighbouring forests are merged into one, as long as what one task would hold stays within ``per_task``
    links. That is measured at every level, as a merge drops what its forests have in common. Forests that
    are too large to be held together, and only they, are finished by contraction.
    """
    a, b = links.columns[:2]
    pairs = links.select(F.col(a).alias("node"), F.col(b).alias("root")).dropna().where("node <> root")
    alone = links.select(F.col(a).alias("node")).union(links.select(F.col(b))).dropna().distinct()
    forest = checkpointed(pairs.mapInArrow(_forest_of, FOREST))
    tasks = forest.rdd.getNumPartitions()
    while tasks > 1:
        together = forest.coalesce(-(-tasks // fan_in))
        if _held(together) > per_task:
            break
        tasks = together.rdd.getNumPartitions()
        forest = checkpointed(together.mapInArrow(_forest_of, FOREST))
    if tasks > 1:
        forest = _stars(forest)
    return alone.join(forest, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _beside_least(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with m, the least v of u. A node of many neighbours is spread over SALTS parts: its least is found within
    each part, then over the parts, and is sent back to just the parts that it has."""
    salted = pairs.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    parts = salted.groupBy("u", "part").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_set("part").alias("parts"))  # at most SALTS of them
    return salted.join(least.select("u", "m", F.explode("parts").alias("part")), ["u", "part"]).select("u", "v", "m")


def _stars(forest: DataFrame) -> DataFrame:
    """Contract links until every node hangs directly under the smallest of its component: large-star, then small-star, until nothing moves."""
    before = None
    while True:
        both = forest.select(F.col("node").alias("u"), F.col("root").alias("v")).union(forest.select(F.col("root"), F.col("node")))
        around = _beside_least(both).select("u", "v", F.least("u", "m").alias("m"))
        large = around.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = checkpointed(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        under = _beside_least(down)
        forest = checkpointed(under.select(F.explode(F.array(F.struct(F.col("v").alias("node"), F.col("m").alias("root")), F.struct(F.col("u").alias("node"), F.col("m").alias("root")))).alias("x")).select("x.*").where("node <> root").distinct())
        state = forest.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if state == before:
            return forest
        before = state


def portion(deficits: list[Fraction], size: int, k: int) -> list[int]:
    """How many of k equal groups each split gets, each going to the split furthest below its target."""
    counts = [0] * len(deficits)
    if not deficits or k <= 0:
        return counts
    steps = lambda level: [max(0, -((level - d) // size)) for d in deficits]  # noqa: E731 - groups until the deficit is at most level
    low, high = min(deficits) - (k + 1) * size, max(deficits)
    for _ in range(200):
        if high - low < Fraction(1, 1_000_000):
            break
        middle = (low + high) / 2
        low, high = (middle, high) if sum(steps(middle)) > k else (low, middle)
    counts = [int(x) for x in steps(high)]
    while sum(counts) < k:
        i = max(range(len(deficits)), key=lambda j: (deficits[j] - counts[j] * size, -j))
        counts[i] += 1
    return counts


def assign_splits(members: DataFrame, group: str, shares: list[tuple[str, float]]) -> DataFrame:
    """Add ``split`` to ``members`` such that all rows of a ``group`` share one.

    ``shares``: name and share of each split in any unit. Groups go largest first, equal
    ones by name, each to the split furthest below its target (of equally far ones, the
    first named). Only the number of groups of each size is brought to the
    driver: at most the square root of twice the rows. Rows without a group stay
    together in one group; no rows give no rows.
    """
    sizes = members.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("size"))
    sizes = checkpointed(sizes)
    histogram = [(r["size"], r["k"]) for r in sizes.groupBy("size").agg(F.count("*").alias("k")).orderBy(F.desc("size")).collect()]
    total, whole = sum(s * k for s, k in histogram), sum(Fraction(str(x)) for _, x in shares)
    deficits = [Fraction(str(x)) * total / whole for _, x in shares]
    table: list[tuple[int, int, int, str]] = []
    for size, k in histogram:
        at = 0
        for j, n in enumerate(portion(deficits, size, k)):
            deficits[j] -= n * size
            if n:
                table.append((size, at, at + n, shares[j][0]))
            at += n
    spark = members.sparkSession
    ranges = spark.createDataFrame(table, "size bigint, lo bigint, hi bigint, split string")
    ranked = rank_within(sizes, "size", [F.col("g")])
    given = ranked.join(ranges, (ranked["size"] == ranges["size"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(F.col("g").alias("__g"), F.col("split"))
    rest = [c for c in members.columns if c != "split"]
    kept = members.select(*rest)
    return kept.join(given, kept[group].eqNullSafe(given["__g"])).select(*rest, "split")
