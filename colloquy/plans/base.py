"""The data set in the conversation model: each record once, times in frames or milliseconds.

Every helper has a counterpart in SQL, a list of common table expressions for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.coverage import periods_and_gaps
from colloquy.schema import FRAME_MS
from colloquy.tables import checkpointed, millis, table


def frames(ms: str, width: int = FRAME_MS) -> F.Column:
    """Milliseconds in frames, halves to even."""
    return F.bround(F.col(ms) / width).cast("bigint")


def conversations(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, source, ms (null unless positive), domain."""
    ms = millis("duration")
    return table(spark, d, "conversation").where("id is not null").select(F.col("id").alias("conv_id"), "source", F.when(ms > 0, ms).alias("ms"), F.col("meta")["domain"].alias("domain")).distinct()


def utterances(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    """Usable utterances of speakers 0 and 1, each once: utt_id, conv_id, speaker, s, e (ms) and ``extra`` columns. What isn't asked for is neither read nor moved."""
    u = table(spark, d, "utterance").select("utt_id", "conv_id", "speaker", millis("start_s").alias("s"), millis("end_s").alias("e"), *extra)
    return u.where("speaker in (0, 1) and e > s and conv_id is not null").distinct()


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Voice-activity segments in 50 Hz frames, touching and overlapping ones merged: conv_id, speaker, i, j."""
    v = table(spark, d, "vad_segment").select("conv_id", "speaker", millis("start_s").alias("s"), millis("end_s").alias("e")).where("speaker in (0, 1)")
    v = v.select("conv_id", "speaker", frames("s").alias("i"), frames("e").alias("j"))
    return periods_and_gaps(v, ["conv_id", "speaker"], "i", "j").where("kind = 'period'").drop("kind")


def timeline(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Segments and lengths, the segments written once because several look-ups read them."""
    seg = checkpointed(segments(spark, d))
    return seg, lengths(spark, d, seg)


def lengths(spark: SparkSession, d: str, seg: DataFrame | None = None) -> DataFrame:
    """conv_id, t: frames of a conversation; its duration or, if that is longer or missing, its last segment."""
    last = (segments(spark, d) if seg is None else seg).groupBy("conv_id").agg(F.max("j").alias("last"))
    whole = conversations(spark, d).select("conv_id", frames("ms").alias("t"))
    return whole.join(last, "conv_id", "left").select("conv_id", F.greatest(F.coalesce("t", F.lit(0)), F.coalesce("last", F.lit(0))).alias("t"))


CONV = """conv AS (
  SELECT DISTINCT id AS conv_id, source, CASE WHEN round(duration * 1000) > 0 THEN CAST(round(duration * 1000) AS BIGINT) END AS ms, meta['domain'] AS domain FROM conversation WHERE id IS NOT NULL)"""
UTT = """utt AS (
  SELECT * FROM (SELECT DISTINCT utt_id, conv_id, speaker, CAST(round(start_s * 1000) AS BIGINT) AS s, CAST(round(end_s * 1000) AS BIGINT) AS e, text, label FROM utterance)
  WHERE speaker IN (0, 1) AND e > s AND conv_id IS NOT NULL)"""
SEG = """v0 AS (
  SELECT conv_id, speaker, CAST(round_even(round(start_s * 1000) / 20, 0) AS BIGINT) AS i, CAST(round_even(round(end_s * 1000) / 20, 0) AS BIGINT) AS j FROM vad_segment WHERE speaker IN (0, 1)),
v1 AS (SELECT *, max(j) OVER (PARTITION BY conv_id, speaker ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pj FROM v0 WHERE j > i AND conv_id IS NOT NULL),
v2 AS (SELECT *, sum(CASE WHEN pj IS NULL OR i > pj THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, speaker ORDER BY i, j ROWS UNBOUNDED PRECEDING) AS k FROM v1),
seg AS (SELECT conv_id, speaker, min(i) AS i, max(j) AS j FROM v2 GROUP BY conv_id, speaker, k)"""
LEN = """len AS (
  SELECT conv.conv_id, greatest(coalesce(CAST(round_even(ms / 20, 0) AS BIGINT), 0), coalesce(l.last, 0)) AS t
  FROM conv LEFT JOIN (SELECT conv_id, max(j) AS last FROM seg GROUP BY 1) l ON l.conv_id = conv.conv_id)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
