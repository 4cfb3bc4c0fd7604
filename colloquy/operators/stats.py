"""Corpus statistics: turn gaps, quantile summaries, histograms, value counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def turn_gaps(spans: DataFrame) -> DataFrame:
    """Gap (>= 0) or overlap (< 0) at each change of speaker: conv_id, at, gap; spans in order of start, end, id."""
    w = Window.partitionBy("conv_id").orderBy("s", "e", "utt_id")
    x = spans.select("conv_id", "s", "speaker", F.lag("speaker").over(w).alias("ps"), F.lag("e").over(w).alias("pe"))
    return x.where("ps <> speaker").select("conv_id", F.col("s").alias("at"), (F.col("s") - F.col("pe")).alias("gap"))


def quantile_summary(value: str | Column, quantiles: tuple[float, ...] = (0.1, 0.5, 0.9), digits: int = 6) -> list[Column]:
    """Aggregates n, mean, quantiles and max; nulls for no rows."""
    v = F.col(value) if isinstance(value, str) else value
    parts = [F.round(F.percentile(v, F.lit(q)), digits).alias(f"p{round(100 * q)}") for q in quantiles]
    return [F.count(v).alias("n"), F.round(F.avg(v), digits).alias("mean"), *parts, F.max(v).alias("max")]


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """bin, n: left-closed bins between edges and an open last one; all bins come out, empty ones with 0."""
    bin_ = F.expr("CASE " + " ".join(f"WHEN {value} < {e} THEN {k - 1}" for k, e in enumerate(edges) if k) + f" ELSE {len(edges) - 1} END")
    counts = df.where(F.col(value) >= edges[0]).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(len(edges)).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def best_within_budgets(sweep: DataFrame, run: str, budgets: list[float]) -> DataFrame:
    """Per run and budget the row of the highest recall (then lowest latency, then theta) whose false-positive rate is within the budget."""
    each = sweep.where("recall is not null").withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).where("fp_rate <= budget")
    best = F.max_by(F.struct("theta", "recall", "fp_rate", "lat_p50"), F.struct("recall", (-F.coalesce("lat_p50", F.lit(1e18))).alias("l"), (-F.col("theta")).alias("t")))
    return each.groupBy(run, "budget").agg(best.alias("b")).select(run, "budget", "b.*")
