"""Planned operators of the model: hazards, slow-clock look-ups, baselines, sampling weights, alignment against activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.operators.asof import last_at_or_before
from colloquy.plans import events as ev
from colloquy.plans.base import SEG, UTT, segments, utterances, with_
from colloquy.plans.frames import _common
from colloquy.tables import table


def hazard_curve(spark: SparkSession, d: str) -> DataFrame:
    """Life table of the time to the next onset: per bin the frames at risk, the onsets in it, hazard and survival after it; censored frames are at risk throughout."""
    n = ev.next_onset_bins(spark, d).groupBy(F.when(F.col("censored"), 99).otherwise(F.col("bin")).alias("bin")).agg(F.sum("n").alias("n"))
    later = Window.orderBy("bin").rowsBetween(0, Window.unboundedFollowing)  # at most seven rows
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    x = n.withColumn("at_risk", F.sum("n").over(later)).withColumn("h", F.col("n") / F.col("at_risk")).where("bin < 99")
    survival = F.exp(F.sum(F.log(F.greatest(1 - F.col("h"), F.lit(1e-12)))).over(upto))
    return x.select("bin", "n", "at_risk", F.round("h", 6).alias("hazard"), F.round(survival, 6).alias("survival"))


def slow_state_age(spark: SparkSession, d: str) -> DataFrame:
    """For every utterance the end of the last activity segment that has arrived by its start, and how old it is, in frames."""
    u = utterances(spark, d).select("conv_id", "speaker", "utt_id", F.bround(F.col("s") / 20).cast("bigint").alias("f"))
    x = last_at_or_before(u, segments(spark, d), ["conv_id", "speaker"], "f", "j", "j", "state")
    return x.where("state is not null").select("utt_id", "state", (F.col("f") - F.col("state")).alias("age"))


def silence_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Ends of turn by silence alone: pauses of a speaker of at least 700 ms, per conversation and speaker."""
    w = Window.partitionBy("conv_id", "speaker").orderBy("i")
    x = segments(spark, d).withColumn("pause", F.lead("i").over(w) - F.col("j"))
    return x.groupBy("conv_id", "speaker").agg(F.count(F.when(F.col("pause") >= 35, 1)).alias("ends"), F.count("*").alias("segments"))


def temperature_weights(spark: SparkSession, d: str) -> DataFrame:
    """Sampling weights of languages at temperature 5."""
    n = table(spark, d, "documents").where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # a row per language
    x = n.withColumn("w", F.pow(F.col("n") / F.sum("n").over(every), F.lit(0.2)))
    return x.select("lang", "n", F.round(F.col("w") / F.sum("w").over(every), 6).alias("weight"))


def alignment_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Frames of each utterance and how many of them its speaker was heard in."""
    u = utterances(spark, d).select("conv_id", "speaker", "utt_id", F.bround(F.col("s") / 20).cast("bigint").alias("i"), F.bround(F.col("e") / 20).cast("bigint").alias("j")).where("j > i")
    heard = _common(u, segments(spark, d), ["conv_id", "speaker"]).groupBy("utt_id").agg(F.sum("n").alias("heard"))
    return u.join(heard, "utt_id", "left").select("utt_id", (F.col("j") - F.col("i")).alias("n"), F.coalesce("heard", F.lit(0)).alias("heard"))


def channel_swap_augmentation(spark: SparkSession, d: str) -> DataFrame:
    """Segments as measured and with the speakers exchanged: active frames per conversation, copy and speaker."""
    s = segments(spark, d).withColumn("swapped", F.lit(False))
    both = s.unionByName(s.withColumns({"speaker": 1 - F.col("speaker"), "swapped": F.lit(True)}))
    return both.groupBy("conv_id", "swapped", "speaker").agg(F.sum(F.col("j") - F.col("i")).alias("n"))


QUERIES = {
    "hazard_curve": hazard_curve, "slow_state_age": slow_state_age, "silence_baseline": silence_baseline, "temperature_weights": temperature_weights,
    "alignment_mismatch": alignment_mismatch, "channel_swap_augmentation": channel_swap_augmentation,
}
SQL = {
    "hazard_curve": ev.SQL["next_onset_bins"].replace("SELECT conv_id, speaker, CASE WHEN d IS NULL", ", nb AS (SELECT conv_id, speaker, CASE WHEN d IS NULL") + """),
n7 AS (SELECT CASE WHEN censored THEN 99 ELSE bin END AS bin, CAST(sum(n) AS BIGINT) AS n FROM nb GROUP BY 1),
r7 AS (SELECT *, CAST(sum(n) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS at_risk FROM n7)
SELECT bin, n, at_risk, round(n / at_risk, 6) AS hazard, round(exp(sum(ln(greatest(1 - n / at_risk, 1e-12))) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING)), 6) AS survival FROM r7 WHERE bin < 99""",
    "slow_state_age": with_(SEG, UTT) + "SELECT utt_id, max(j) AS state, any_value(f) - max(j) AS age FROM (SELECT utt_id, conv_id, speaker, CAST(round_even(s / 20, 0) AS BIGINT) AS f FROM utt) u JOIN seg ON seg.conv_id = u.conv_id AND seg.speaker = u.speaker AND seg.j <= u.f GROUP BY 1",
    "silence_baseline": with_(SEG) + "SELECT conv_id, speaker, count(*) FILTER (pause >= 35) AS ends, count(*) AS segments FROM (SELECT *, lead(i) OVER (PARTITION BY conv_id, speaker ORDER BY i) - j AS pause FROM seg) GROUP BY 1, 2",
    "temperature_weights": "SELECT lang, n, round(w / sum(w) OVER (), 6) AS weight FROM (SELECT lang, n, pow(n / sum(n) OVER (), 0.2) AS w FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1))",
    "alignment_mismatch": with_(SEG, UTT) + """, u AS (SELECT utt_id, conv_id, speaker, CAST(round_even(s / 20, 0) AS BIGINT) AS i, CAST(round_even(e / 20, 0) AS BIGINT) AS j FROM utt)
SELECT utt_id, any_value(u.j - u.i) AS n, CAST(sum(CASE WHEN seg.i IS NULL THEN 0 ELSE least(u.j, seg.j) - greatest(u.i, seg.i) END) AS BIGINT) AS heard FROM u LEFT JOIN seg ON seg.conv_id = u.conv_id AND seg.speaker = u.speaker AND seg.i < u.j AND seg.j > u.i WHERE u.j > u.i GROUP BY 1""",
    "channel_swap_augmentation": with_(SEG) + "SELECT conv_id, swapped, CASE WHEN swapped THEN 1 - speaker ELSE speaker END AS speaker, CAST(sum(j - i) AS BIGINT) AS n FROM seg CROSS JOIN (VALUES (true), (false)) x(swapped) GROUP BY 1, 2, 3",
}
