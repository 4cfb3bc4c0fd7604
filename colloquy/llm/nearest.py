"""Nearest record in time of the same entity within a tolerance.

Both tables are put into one stream: repartitioned by entity and time window, sorted
by instant within a partition, and merged by an iterator that holds nothing but the
right records next to the place it has come to. A right record is sent to each of
the (at most two) windows of an entity it can serve, so that an entity that holds
a large part of all rows is spread over as many tasks as it has windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.arrow import codes, concat_batches, run_starts

RIGHT, LEFT = 0, 1


def _merge(batches: Iterator[pa.RecordBatch], n_keys: int, tolerance: int) -> Iterator[pa.RecordBatch]:
    """Rows (keys, window, at, side, id) in this order -> (left id, right id)."""
    held: pa.RecordBatch | None = None
    n_held = 0  # rows of it, which have been seen before; done: which of them have their answer
    done = np.zeros(0, bool)

    def match(b: pa.RecordBatch, last: bool) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        group = np.cumsum(run_starts(*(codes(b.column(i)) for i in range(n_keys + 1)))) - 1
        at, side, who = (np.asarray(b.column(n_keys + i)).astype(np.int64) for i in (1, 2, 3))
        n, here = len(at), np.arange(len(at))
        fresh = run_starts(group, at, side)
        first = np.maximum.accumulate(np.where(fresh, here, 0))  # of the equal instants of one side, the smallest id
        before = np.maximum.accumulate(np.where(side == RIGHT, here, -1))
        before = np.where(before >= 0, first[before], -1)
        after = np.minimum.accumulate(np.where(side == RIGHT, here, n)[::-1])[::-1]
        has_before, has_after = (before >= 0) & (group[before] == group), after < n
        has_after[has_after] = group[after[has_after]] == group[has_after]
        far = tolerance + 1
        to_before = np.where(has_before, at - at[before], far)
        to_after = np.full(n, far)
        to_after[has_after] = at[after[has_after]] - at[has_after]
        smaller = np.zeros(n, bool)
        both = has_before & has_after
        smaller[both] = who[after[both]] < who[before[both]]
        take_after = (to_after < to_before) | ((to_after == to_before) & smaller)
        best = np.where(take_after, np.minimum(after, n - 1), before)
        near = np.minimum(to_before, to_after)
        settled = np.full(n, last) | has_after | (group < group[-1]) | (at[-1] - at > tolerance)
        left = side == LEFT
        seen = np.zeros(n, bool)
        seen[:n_held] = done
        again = np.zeros(n, bool)  # a repeated row of one left record
        again[1:] = left[1:] & ~fresh[1:] & (who[1:] == who[:-1])
        out = left & settled & ~seen & ~again & (near <= tolerance)
        result = pa.RecordBatch.from_arrays([b.column(n_keys + 3).take(pa.array(x)) for x in (here[out], best[out])], ["a", "b"])
        open_left = np.flatnonzero(left & ~settled)
        ending = group == group[-1]
        rights = np.flatnonzero((side == RIGHT) & ending)
        since = n
        if len(open_left):
            since = open_left[0]
            since = before[since] if has_before[since] else since
        elif len(rights):
            since = first[rights[-1]]
        keep = ending & (here >= since) & ((side == RIGHT) | ~settled)
        keep[-1] = True  # so that a repetition of the last row is known as one
        return result, np.flatnonzero(keep), settled[keep] & left[keep]

    for b in batches:
        if not b.num_rows:
            continue
        b = concat_batches([held, b]) if held is not None else b
        result, keep, done = match(b, False)
        if result.num_rows:
            yield result
        held, n_held = b.take(pa.array(keep)), len(keep)
    if held is not None:
        result = match(held, True)[0]
        if result.num_rows:
            yield result


def match_nearest(
    left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, left_at: str, right_at: str, tolerance: int, window: int | None = None
) -> DataFrame:
    """For each left record the right record of equal ``keys`` nearest to it in time.

    ``left_at`` and ``right_at`` are whole numbers of one unit, ids are whole
    numbers. Result: one row (``left_id``, ``right_id``) for each left record that has a
    right one at most ``tolerance`` units away; of equally near ones, the
    one of the smaller id. A right record may serve several left ones. Rows with
    a null key, id or instant match nothing; repeated rows count once; further
    columns are ignored, whatever their names.
    """
    window = window or max(2 * tolerance, 60_000)

    def rows(df: DataFrame, who: str, at: str, side: int) -> DataFrame:
        named = df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(at).cast("bigint").alias("at"), F.lit(side).alias("side"), F.col(who).cast("bigint").alias("id"))
        return named.dropna()

    def cell(c: F.Column) -> F.Column:
        return F.floor(c / F.lit(window)).cast("bigint")

    k, at = [f"k{i}" for i in range(len(keys))], F.col("at")
    here = rows(left, left_id, left_at, LEFT).withColumn("w", cell(at))
    there = rows(right, right_id, right_at, RIGHT).withColumn("w", F.explode(F.array_distinct(F.array(cell(at - tolerance), cell(at), cell(at + tolerance)))))
    order = [*k, "w", "at", "side", "id"]
    stream = here.select(*order).unionByName(there.select(*order)).repartition(*k, "w").sortWithinPartitions(*order)
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    found = stream.mapInArrow(lambda it: _merge(it, len(keys), tolerance), schema)
    return found.select(F.col("a").alias(left_id), F.col("b").alias(right_id))
