"""Pieces of oversized items, cut at the strongest natural boundary in reach.

The boundaries of an item stream by in order of place. A piece ends at the strongest
boundary of the window it may end in, found by a sparse-table range maximum whose
ties go to the right; the next piece begins an overlap before that end. Only the
boundaries from the current piece on are held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from colloquy.functions.arrow import codes, run_starts


class RangeMaximum:
    """Place of the maximum of any range of an array in constant time; of equal maxima, the rightmost."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.levels = [np.arange(len(values))]
        step = 1
        while 2 * step <= len(values):
            a, b = self.levels[-1][:-step], self.levels[-1][step:]
            self.levels.append(np.where(values[a] > values[b], a, b))
            step *= 2

    def best(self, lo: int, hi: int) -> int:
        """Index of the maximum of values[lo:hi], which isn't empty."""
        k = (hi - lo).bit_length() - 1
        a, b = self.levels[k][lo], self.levels[k][hi - (1 << k)]
        return int(a if self.values[a] > self.values[b] else b)


class _Walk:
    """The pieces of one item, as its boundaries come in."""

    def __init__(self, total: int, limit: int, overlap: int):
        self.total, self.limit, self.overlap, self.start, self.no = total, limit, overlap, 0, 1
        self.over = total <= limit  # an item within the limit isn't cut

    def advance(self, at: np.ndarray, strength: np.ndarray, complete: bool) -> tuple[list[tuple[int, int, int]], int]:
        """Pieces that are certain now, and from which boundary on the rest is needed."""
        out, index = [], None
        while not self.over:
            if self.total - self.start <= self.limit:
                out.append((self.no, self.start, self.total))
                self.over = True
                break
            if not complete and not (len(at) and at[-1] > self.start + self.limit):
                break
            lo = int(np.searchsorted(at, self.start + self.overlap, "right"))
            hi = int(np.searchsorted(at, self.start + self.limit, "right"))
            end = self.start + self.limit
            if lo < hi:
                index = index or RangeMaximum(strength)
                end = int(at[index.best(lo, hi)])
            out.append((self.no, self.start, end))
            self.start, self.no = end - self.overlap, self.no + 1
        return out, len(at) if self.over else int(np.searchsorted(at, self.start + self.overlap, "right"))


def _cut(batches: Iterator[pa.RecordBatch], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Rows (item, at, strength, total) by item and at, the total first (at null) -> pieces."""
    walk: _Walk | None = None
    item = None
    at, strength = np.zeros(0, np.int64), np.zeros(0)

    def emit(parts: list[tuple[object, list[tuple[int, int, int]]]], kind: pa.DataType) -> pa.RecordBatch:
        names = [i for i, p in parts for _ in p]
        rows = np.array([x for _, p in parts for x in p], np.int64).reshape(-1, 3)
        return pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(rows[:, 0].astype(np.int32)), pa.array(rows[:, 1]), pa.array(rows[:, 2])], ["item", "no", "s", "e"])

    kind = pa.string()
    for b in batches:
        if not b.num_rows:
            continue
        kind, parts = b.column(0).type, []
        firsts = np.flatnonzero(run_starts(codes(b.column(0))))
        places = np.asarray(b.column(1).fill_null(-1)).astype(np.int64)
        weights = np.asarray(b.column(2).fill_null(0)).astype(float)
        totals = np.asarray(b.column(3).fill_null(-1)).astype(np.int64)
        for lo, hi in zip(firsts, np.append(firsts[1:], b.num_rows), strict=True):
            name = b.column(0)[int(lo)].as_py()
            if name != item:
                if walk:
                    parts.append((item, walk.advance(at, strength, True)[0]))
                item, walk = name, (_Walk(int(totals[lo]), limit, overlap) if totals[lo] >= 0 else None)
                at, strength = np.zeros(0, np.int64), np.zeros(0)
            if not walk or walk.over:
                continue
            new = places[lo:hi] >= 0
            at, strength = np.concatenate([at, places[lo:hi][new]]), np.concatenate([strength, weights[lo:hi][new]])
            got, rest = walk.advance(at, strength, False)
            at, strength = at[rest:], strength[rest:]
            parts.append((item, got))
        yield emit(parts, kind)
    if walk:
        yield emit([(item, walk.advance(at, strength, True)[0])], kind)


def cut_items(items: DataFrame, boundaries: DataFrame, item: str, total: str, at: str, strength: str, limit: int, overlap: int) -> DataFrame:
    """Pieces of at most ``limit`` units of every item longer than that.

    ``items``: ``item`` and its length ``total``; ``boundaries``: ``item``, place
    ``at`` >= 0 and ``strength``. A piece ends at the strongest boundary more than
    ``overlap`` and at most ``limit`` after its start (of equal ones the last), or
    exactly ``limit`` after it if there is none; the next begins ``overlap`` before that
    end; a rest within the limit is the last piece. Result: ``item``, ``piece_no`` (from
    1), ``start``, ``end``. Items of null or too small a length have no pieces, neither
    have boundaries of unknown items; repeated items count once.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")
    i = F.col(item)
    whole = items.select(i.alias("item"), F.lit(None).cast("bigint").alias("at"), F.lit(0.0).alias("strength"), F.col(total).cast("bigint").alias("total"))
    whole = whole.where((F.col("total") > limit) & i.isNotNull()).distinct()
    marks = boundaries.select(i.alias("item"), F.col(at).cast("bigint").alias("at"), F.col(strength).cast("double").alias("strength"), F.lit(None).cast("bigint").alias("total"))
    marks = marks.where((F.col("at") >= 0) & i.isNotNull())
    stream = whole.unionByName(marks).repartition("item").sortWithinPartitions("item", "at", F.desc_nulls_last("strength"))
    kind = T.StructType([T.StructField("item", items.schema[item].dataType), T.StructField("no", T.IntegerType()), T.StructField("s", T.LongType()), T.StructField("e", T.LongType())])
    pieces = stream.mapInArrow(lambda it: _cut(it, limit, overlap), kind)
    return pieces.select(F.col("item").alias(item), F.col("no").alias("piece_no"), F.col("s").alias("start"), F.col("e").alias("end"))


def quiet_ends(intervals: DataFrame, item: str, start: str, end: str, shard: int = 600_000) -> DataFrame:
    """Ends of intervals at which no interval of the item is under way (start < t < end).

    Result: ``item``, ``at``, without repetition. An interval is sent to every time shard
    of its item that it reaches, so long items are spread over many tasks. Rows
    with a null or with ``end <= start`` are left out.
    """
    s, e, k = F.col("s"), F.col("e"), F.col("k")
    rows = intervals.select(F.col(item).alias("item"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e")).dropna().where("e > s")
    rows = rows.withColumn("k", F.explode(F.sequence(F.floor(s / shard), F.floor(e / shard))))
    w = Window.partitionBy("item", "k").orderBy("s", "e")
    reach = rows.withColumn("before", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    runs = reach.withColumn("run", F.sum(F.when(F.col("before").isNull() | (s >= F.col("before")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = runs.groupBy("item", "k", "run").agg(F.max("e").alias("at")).where(F.floor(F.col("at") / shard) == k)
    return ends.select(F.col("item").alias(item), "at")
