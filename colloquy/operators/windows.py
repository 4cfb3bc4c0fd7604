"""Windows, splits, limits and grid filters over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sliding_windows(length: DataFrame, window: int, hop: int) -> DataFrame:
    """Windows that fit whole into a conversation of ``t`` units: conv_id, win, start."""
    n = F.floor((F.col("t") - window) / hop).cast("int")
    return length.where(F.col("t") >= window).select("conv_id", F.explode(F.sequence(F.lit(0), n)).alias("win")).withColumn("start", F.col("win").cast("bigint") * hop)


def silent_starts(spans: DataFrame, window: int, grid: int, margin: int) -> DataFrame:
    """Grid instants at which no span (conv_id, s, e) is under way within ``margin``, as long as a window fits: conv_id, start.

    The spans are widened, cut to grid cells and removed by an anti join on equal cells.
    """
    end = spans.groupBy("conv_id").agg(F.max("e").alias("end")).where(F.col("end") >= window)
    every = end.select("conv_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("end") - window) / grid).cast("int"))).alias("g"))
    lo, hi = F.ceil((F.col("s") - margin) / grid).cast("int"), (F.ceil((F.col("e") + margin) / grid) - 1).cast("int")
    taken = spans.select("conv_id", lo.alias("lo"), hi.alias("hi")).where("hi >= lo").select("conv_id", F.explode(F.sequence("lo", "hi")).alias("g")).distinct()
    return every.join(taken, ["conv_id", "g"], "left_anti").select("conv_id", (F.col("g").cast("bigint") * grid).alias("start"))


def drop_touched(windows: DataFrame, spans: DataFrame, window: int, hop: int) -> DataFrame:
    """Windows (conv_id, win, start) that no span (conv_id, s, e) overlaps; spans meet windows by window number."""
    lo, hi = F.greatest(F.floor((F.col("s") - window) / hop) + 1, F.lit(0)).cast("int"), (F.ceil(F.col("e") / hop) - 1).cast("int")
    hit = spans.select("conv_id", lo.alias("lo"), hi.alias("hi")).where("hi >= lo").select("conv_id", F.explode(F.sequence("lo", "hi")).alias("win")).distinct()
    return windows.join(hit, ["conv_id", "win"], "left_anti").select("conv_id", "win", "start")


def slice_events(windows: DataFrame, events: DataFrame, window: int, hop: int) -> DataFrame:
    """Events (conv_id, f, speaker, kind) of each window, times counted from its start."""
    lo, hi = F.greatest(F.ceil((F.col("f") - window + 1) / hop), F.lit(0)).cast("int"), F.floor(F.col("f") / hop).cast("int")
    placed = events.withColumn("win", F.explode(F.sequence(lo, hi)))
    return windows.join(placed, ["conv_id", "win"]).select("conv_id", "win", (F.col("f") - F.col("start")).alias("f"), "speaker", "kind")


def split_last(ids: DataFrame, key: str, fraction: float) -> DataFrame:
    """``split``: val for the last max(1, n * fraction) ids in string order, else train.

    Ids are put into range partitions; with the number of rows of each, the driver knows the place of the cut, and every row its own place.
    """
    from colloquy.tables import checkpointed

    names = ids.select(F.col(key).cast("string").alias(key)).distinct()
    placed = checkpointed(names.repartitionByRange(key).withColumn("__p", F.spark_partition_id()))
    counts = placed.groupBy("__p").count().orderBy("__p").collect()  # a row per partition
    n, before, base = sum(r["count"] for r in counts), [], 0
    for r in counts:
        before.append((r["__p"], base))
        base += r["count"]
    offsets = F.broadcast(ids.sparkSession.createDataFrame(before, "__p int, __base bigint"))  # a row per partition
    place = F.row_number().over(Window.partitionBy("__p").orderBy(key)) + F.col("__base")
    cut = n - max(1, int(n * fraction))
    return placed.join(offsets, "__p").select(key, F.when(place > cut, "val").otherwise("train").alias("split"))


def cumulative_limit(rows: DataFrame, key: str, size: str, limit: int) -> DataFrame:
    """Rows in order of ``key`` as long as the total of ``size`` before them is below ``limit``.

    Running totals are taken within range partitions and added up from one total per partition.
    """
    from colloquy.tables import checkpointed

    placed = checkpointed(rows.select(key, size).repartitionByRange(key).withColumn("__p", F.spark_partition_id()))
    totals = placed.groupBy("__p").agg(F.sum(size).alias("v")).orderBy("__p").collect()  # a row per partition
    base, before = 0, []
    for r in totals:
        before.append((r["__p"], base))
        base += r["v"] or 0
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "__p int, __base bigint"))  # a row per partition
    w = Window.partitionBy("__p").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    running = placed.withColumn("__before", F.coalesce(F.sum(size).over(w), F.lit(0)))
    return running.join(offsets, "__p").where(F.col("__before") + F.col("__base") < limit).select(key, size)


def sample_per_group(rows: DataFrame, group: str, key: str, k: int, salt: int = 7919) -> DataFrame:
    """At most k rows of each group, by an arithmetic order of ``key`` that is the same on every run."""
    w = Window.partitionBy(group).orderBy(F.pmod(F.col(key) * salt, F.lit(100_003)), key)
    return rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).drop("__k")


def pad_batches(rows: DataFrame, group: str, values: str, pad: int) -> DataFrame:
    """Arrays padded to the longest of their group."""
    most = rows.groupBy(group).agg(F.max(F.size(values)).alias("__n"))
    return rows.join(most, group).withColumn(values, F.concat(values, F.array_repeat(F.lit(pad), F.col("__n") - F.size(values)))).drop("__n")
