"""Continuous periods and gaps of intervals per entity, by run bitmaps.

Time is discrete (whole units, such as milliseconds). The axis of an entity is cut
into shards of 65,536 units; what an entity covers of a shard is a run container,
that is a bitmap written as little-endian pairs of 16-bit (first bit, length - 1).
Containers are united once within each map task, before the shuffle, and once after
it, per (entity, shard) in a stream; so a busy entity is spread over as many tasks
as it has shards and no group is ever held in memory. Runs that have a neighbour on either side in their shard
are final; only the first and last of each shard go on, as one small row, to a window that joins those that touch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from colloquy.functions.arrow import codes, concat_batches, list_array, run_starts

SHARD_BITS = 16
SHARD = 1 << SHARD_BITS


def unite(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set runs of each group: group numbers ascend, lo ascends within a group, 0 <= lo < hi <= SHARD."""
    if not len(lo):
        return group, lo, hi
    base = group * (SHARD + 1)
    reach = np.maximum.accumulate(base + hi)
    first = np.ones(len(lo), bool)
    first[1:] = (base + lo)[1:] > reach[:-1]
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(lo)) - 1
    return group[at], lo[at], reach[last] - base[at]


def pack(lo: np.ndarray, hi: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Run containers: one binary value for each row."""
    pairs = np.empty((len(lo), 2), "<u2")
    pairs[:, 0], pairs[:, 1] = lo, hi - lo - 1
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths * 4, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(pairs.tobytes())])


def unpack(container: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, first bit and end of every run of a column of containers."""
    n = len(container)
    offsets = np.frombuffer(container.buffers()[1], np.int32, n + 1, container.offset * 4)
    raw = container.buffers()[2]
    pairs = np.frombuffer(raw, "<u2", (offsets[-1] - offsets[0]) // 2, offsets[0]).reshape(-1, 2).astype(np.int64) if raw else np.zeros((0, 2), np.int64)
    rows = np.repeat(np.arange(n), np.diff(offsets) // 4)
    return rows, pairs[:, 0], pairs[:, 0] + pairs[:, 1] + 1


def _containers_of(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Columns: keys, shard, lo, hi -> keys, shard, container; united within each batch."""
    for b in batches:
        if not b.num_rows:
            continue
        keys = [codes(b.column(i)) for i in range(n_keys + 1)]
        lo, hi = (np.asarray(b.column(n_keys + i)).astype(np.int64) for i in (1, 2))
        order = np.lexsort([lo, *keys[::-1]])
        first = run_starts(*(k[order] for k in keys))
        group, lo, hi = unite(np.cumsum(first) - 1, lo[order], hi[order])
        at = pa.array(order[first])
        lengths = np.bincount(group, minlength=int(first.sum()))
        columns = [b.column(i).take(at) for i in range(n_keys + 1)] + [pack(lo, hi, lengths)]
        yield pa.RecordBatch.from_arrays(columns, [*b.schema.names[: n_keys + 1], "__runs"])


def _unite_sorted(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Containers sorted by keys and shard -> keys, shard, lists of run starts and ends."""

    def runs(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        first = run_starts(*(codes(b.column(i)) for i in range(n_keys + 1)))
        rows, lo, hi = unpack(b.column(n_keys + 1))
        group = (np.cumsum(first) - 1)[rows]
        order = np.lexsort([lo, group])
        return np.flatnonzero(first), *unite(group[order], lo[order], hi[order])

    def out(b: pa.RecordBatch, at: np.ndarray, group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
        lengths, rows = np.bincount(group, minlength=len(at)), pa.array(at)
        columns = [b.column(i).take(rows) for i in range(n_keys + 1)]
        columns += [list_array(pa.array(x.astype(np.int32)), lengths) for x in (lo, hi)]
        return pa.RecordBatch.from_arrays(columns, [*b.schema.names[: n_keys + 1], "__lo", "__hi"])

    held: pa.RecordBatch | None = None  # the last group so far, already united
    for b in batches:
        if not b.num_rows:
            continue
        b = concat_batches([held, b]) if held is not None else b
        at, group, lo, hi = runs(b)
        done, last = group < len(at) - 1, len(at) - 1
        if last:
            yield out(b, at[:last], group[done], lo[done], hi[done])
        rest = ~done
        columns = [b.column(i).slice(int(at[last]), 1) for i in range(n_keys + 1)]
        held = pa.RecordBatch.from_arrays([*columns, pack(lo[rest], hi[rest], np.array([rest.sum()]))], b.schema.names)
    if held is not None:
        yield out(held, *runs(held))


def periods_and_gaps(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Longest unbroken stretches of each entity and the gaps between neighbouring ones.

    ``intervals``: one row per interval ``[start, end)`` in whole units; intervals of
    one entity may overlap, nest, touch or repeat. Result: ``keys``, ``kind``
    (``period`` or ``gap``), ``start`` and ``end`` under their given names; further
    columns of the input are dropped. Touching intervals are not broken. Rows with a null
    key, a null time or ``end <= start`` cover nothing. An entity without
    intervals has no rows; an empty input gives an empty result.
    """
    s, e, shard = F.col(start).cast("bigint"), F.col(end).cast("bigint"), F.col("__shard")
    valid = (e > s) & F.lit(True)
    for k in keys:
        valid &= F.col(k).isNotNull()
    cut = intervals.where(valid).select(
        *keys, F.explode(F.sequence(F.shiftright(s, SHARD_BITS), F.shiftright(e - 1, SHARD_BITS))).alias("__shard"), s.alias("__s"), e.alias("__e")
    )
    origin = shard * SHARD
    cut = cut.select(
        *keys, "__shard",
        (F.greatest(F.col("__s"), origin) - origin).cast("int").alias("__lo"),
        (F.least(F.col("__e"), origin + SHARD) - origin).cast("int").alias("__hi"),
    )
    n, types = len(keys), [intervals.schema[k] for k in keys]
    head = T.StructType([*types, T.StructField("__shard", T.LongType())])
    packed = T.StructType([*head, T.StructField("__runs", T.BinaryType())])
    listed = T.StructType([*head, T.StructField("__lo", T.ArrayType(T.IntegerType())), T.StructField("__hi", T.ArrayType(T.IntegerType()))])
    by = [*keys, "__shard"]
    containers = cut.mapInArrow(lambda it: _containers_of(it, n), packed)
    shards = containers.repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda it: _unite_sorted(it, n), listed)

    n_runs = F.size("__lo")
    at = lambda name, k: F.element_at(name, k).cast("bigint") + origin
    row = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("s"), b.alias("e"))
    # what lies wholly within a shard needs no neighbour and goes out as it is
    inner_gaps = F.transform(F.sequence(F.lit(1), n_runs - 1), lambda k: row("gap", at("__hi", k), at("__lo", k + 1)))
    inner_periods = F.when(n_runs > 2, F.transform(F.sequence(F.lit(2), n_runs - 1), lambda k: row("period", at("__lo", k), at("__hi", k)))).otherwise(F.array().cast("array<struct<kind:string,s:bigint,e:bigint>>"))
    inner = shards.where(n_runs > 1).select(*keys, F.explode(F.concat(inner_gaps, inner_periods)).alias("__r"))
    # the first and last run of each shard, one small row a shard, meet those of its neighbours
    edge = shards.select(*keys, "__shard", n_runs.alias("__n"), at("__lo", 1).alias("__first"), at("__hi", 1).alias("__first_end"), at("__lo", -1).alias("__open"), at("__hi", -1).alias("__last"))
    w = Window.partitionBy(*keys).orderBy("__shard")
    edge = edge.withColumns({"__before": F.lag("__last").over(w), "__after": F.lead("__first").over(w)}).withColumn("__left", F.coalesce(F.col("__before") == F.col("__first"), F.lit(False)))
    opened = F.last(F.when((F.col("__n") > 1) | ~F.col("__left"), F.col("__open")), ignorenulls=True)
    edge = edge.withColumn("__since", opened.over(w.rowsBetween(Window.unboundedPreceding, -1)))
    begin = F.when(F.col("__left"), F.col("__since")).otherwise(F.col("__first"))
    goes_on = F.coalesce(F.col("__after") == F.col("__last"), F.lit(False))
    outer = F.array(
        F.when(~F.col("__left") & F.col("__before").isNotNull(), row("gap", F.col("__before"), F.col("__first"))),
        F.when(F.col("__n") > 1, row("period", begin, F.col("__first_end"))),
        F.when(~goes_on, row("period", F.when(F.col("__n") > 1, F.col("__open")).otherwise(begin), F.col("__last"))),
    )
    rows = inner.union(edge.select(*keys, F.explode(F.array_compact(outer)).alias("__r")))
    return rows.select(*keys, F.col("__r.kind").alias("kind"), F.col("__r.s").alias(start), F.col("__r.e").alias(end))
