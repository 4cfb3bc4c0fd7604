"""Detection scores: threshold sweeps, operating points, matching of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def threshold_sweep(scored: DataFrame, run: str, thetas: list[int], scale: int) -> DataFrame:
    """Recall, false-positive rate and median delay at each threshold: run, theta, recall, fp_rate, lat_p50.

    ``scored``: run, ``score`` (whole number of 1/scale), ``gold`` (boolean), ``delay`` (ms). Scores are first counted per value of
    the threshold grid they reach, so a row is seen once and not once per threshold.
    """
    grid = scored.sparkSession.createDataFrame([(t,) for t in thetas], "t int")
    totals = scored.groupBy(run).agg(F.count(F.when(F.col("gold"), 1)).alias("p"), F.count(F.when(~F.col("gold"), 1)).alias("n"))
    hits = scored.groupBy(run, "score", "gold", "delay").agg(F.count("*").alias("k"))
    x = hits.join(F.broadcast(grid), F.col("score") >= F.col("t"))  # the grid is a parameter
    at = x.groupBy(run, "t").agg(
        F.coalesce(F.sum(F.when(F.col("gold"), F.col("k"))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(~F.col("gold"), F.col("k"))), F.lit(0)).alias("fp"),
        F.percentile(F.when(F.col("gold"), F.col("delay")), F.lit(0.5), F.when(F.col("gold"), F.col("k")).otherwise(1)).alias("lat"),
    )
    every = totals.join(F.broadcast(grid), F.lit(True)).join(at, [run, "t"], "left")
    rate = lambda a, b: F.round(F.coalesce(a, F.lit(0)) / F.when(F.col(b) > 0, F.col(b)), 6)
    return every.select(run, (F.col("t") / scale).alias("theta"), rate(F.col("tp"), "p").alias("recall"), rate(F.col("fp"), "n").alias("fp_rate"), F.round("lat", 3).alias("lat_p50"))


def match_events(gold: DataFrame, predicted: DataFrame, keys: list[str], before: int, after: int) -> DataFrame:
    """Match each gold instant, in order, with the earliest unclaimed prediction from ``before`` ahead of it to ``after`` behind it.

    Result: keys, at, hit (null if missed). Greedy and one to one, hence in order per key; both tables are cut
    where nothing lies within reach of each other, and each such stretch is matched by itself.
    """
    both = gold.select(*keys, F.col("at").alias("at"), F.lit(0).alias("side")).unionByName(predicted.select(*keys, F.col("at").alias("at"), F.lit(1).alias("side")))
    w = Window.partitionBy(*keys).orderBy("at", "side")
    far = F.col("at") - F.lag("at").over(w) > max(before, after)
    both = both.withColumn("cut", F.when(far, 1).otherwise(0)).withColumn("stretch", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def match(golds: list[int], preds: list[int]) -> list[int | None]:
        out, lo = [], 0
        for t in golds:
            while lo < len(preds) and preds[lo] < t - before:
                lo += 1
            hit = preds[lo] if lo < len(preds) and preds[lo] <= t + after else None
            lo += hit is not None  # whatever lies before a claimed prediction is out of reach of later golds or claimed
            out.append(hit)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, golds, preds, rows = None, [], [], []
        for b in batches:
            for *k, stretch, at, side in b.itertuples(index=False):
                if (k, stretch) != key:
                    rows += [(*key[0], g, h) for g, h in zip(golds, match(golds, preds), strict=True)] if key else []
                    key, golds, preds = (k, stretch), [], []
                (preds if side else golds).append(at)
            yield pd.DataFrame(rows, columns=[*keys, "at", "hit"]).astype({"hit": "Int64"})
            rows = []
        if key:
            rows = [(*key[0], g, h) for g, h in zip(golds, match(golds, preds), strict=True)]
            yield pd.DataFrame(rows, columns=[*keys, "at", "hit"]).astype({"hit": "Int64"})

    order = [*keys, "stretch", "at", "side"]
    types = ", ".join(f"{k} {both.schema[k].dataType.simpleString()}" for k in keys)
    return both.select(*order).repartition(*keys, "stretch").sortWithinPartitions(*order).mapInPandas(run, f"{types}, at bigint, hit bigint")
