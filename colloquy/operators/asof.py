"""As-of look-ups by one sort per key, in place of range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _tagged(left: DataFrame, right: DataFrame, keys: list[str], left_at: Column, right_at: Column, value: Column) -> DataFrame:
    l = left.select(*keys, left_at.alias("__at"), F.lit(None).cast("bigint").alias("__v"), F.struct(*left.columns).alias("__row"))
    r = right.select(*keys, right_at.alias("__at"), value.cast("bigint").alias("__v"), F.lit(None).cast(l.schema["__row"].dataType).alias("__row"))
    return l.unionByName(r)


def next_at_or_after(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, out: str, strict: bool = False) -> DataFrame:
    """Add ``out``: the smallest ``right_at`` of equal keys at or after (strict: after) ``left_at``, else null."""
    both = _tagged(left, right, keys, F.col(left_at), F.col(right_at), F.col(right_at))
    # rows are read from the end; a right row comes before a left one of its instant if it counts for it
    rank = F.when(F.col("__row").isNull(), 1 if strict else 0).otherwise(0 if strict else 1)
    w = Window.partitionBy(*keys).orderBy(F.col("__at").desc(), rank).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("__n", F.last("__v", ignorenulls=True).over(w)).where("__row is not null").select("__row.*", F.col("__n").alias(out))


def last_at_or_before(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, value: str, out: str, strict: bool = False) -> DataFrame:
    """Add ``out``: ``value`` of the right row with the largest ``right_at`` at or before (strict: before) ``left_at``, else null."""
    both = _tagged(left, right, keys, F.col(left_at), F.col(right_at), F.col(value))
    rank = F.when(F.col("__row").isNull(), 1 if strict else 0).otherwise(0 if strict else 1)
    w = Window.partitionBy(*keys).orderBy("__at", rank).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("__n", F.last("__v", ignorenulls=True).over(w)).where("__row is not null").select("__row.*", F.col("__n").alias(out))
