"""Ranks within classes, over any number of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.tables import checkpointed


def rank_within(df: DataFrame, by: str, order: list[Column], out: str = "rank") -> DataFrame:
    """Add ``out``: 0, 1, ... within each value of ``by`` in the given order.

    Rows are range-partitioned by class and order, so one class may fill many partitions; only
    the number of rows of each (partition, class) goes to the driver, at most as many
    numbers as there are partitions and classes together. Use it for few classes.
    """
    placed = df.repartitionByRange(F.col(by), *order).withColumn("__pid", F.spark_partition_id())
    placed = checkpointed(placed)
    counts = placed.groupBy("__pid", by).count().orderBy(F.col(by), "__pid").collect()
    before, base, last = [], 0, object()
    for r in counts:
        base = 0 if r[by] != last else base
        last = r[by]
        before.append((r["__pid"], r[by], base))
        base += r["count"]
    spark = df.sparkSession
    kind = df.schema[by].dataType.simpleString()
    offsets = spark.createDataFrame(before, f"__pid int, __by {kind}, __base bigint")
    inner = F.row_number().over(Window.partitionBy("__pid", by).orderBy(*order)).cast("bigint") - 1
    ranked = placed.withColumn("__inner", inner).join(offsets, (placed["__pid"] == offsets["__pid"]) & placed[by].eqNullSafe(offsets["__by"]))
    return ranked.select(*df.columns, (F.col("__inner") + F.col("__base")).alias(out))
