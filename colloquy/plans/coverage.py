"""Query and SQL of the continuous-periods operator over the data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.coverage import periods_and_gaps
from colloquy.tables import table, usable_utterances


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances and voice-activity segments of speakers 0 and 1, in one list of intervals."""
    said = usable_utterances(table(spark, sf_dir, "utterance"), "speaker")
    heard = usable_utterances(table(spark, sf_dir, "vad_segment"), "speaker")
    return said.unionByName(heard).where(F.col("speaker").isin(0, 1))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of activity of each speaker of a conversation and the gaps between them."""
    return periods_and_gaps(activity(spark, sf_dir), ["conv_id", "speaker"], "start_ms", "end_ms")


P4_SQL = """
WITH iv AS (
  SELECT conv_id, speaker, CAST(round(start_s * 1000) AS BIGINT) AS s, CAST(round(end_s * 1000) AS BIGINT) AS e FROM utterance WHERE speaker IN (0, 1)
  UNION ALL
  SELECT conv_id, speaker, CAST(round(start_s * 1000) AS BIGINT), CAST(round(end_s * 1000) AS BIGINT) FROM vad_segment WHERE speaker IN (0, 1)
), ok AS (SELECT * FROM iv WHERE e > s AND conv_id IS NOT NULL),
reach AS (
  SELECT *, max(e) OVER (PARTITION BY conv_id, speaker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ok
), island AS (
  SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, speaker ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM reach
), period AS (
  SELECT conv_id, speaker, k, min(s) AS start_ms, max(e) AS end_ms FROM island GROUP BY 1, 2, 3
), following AS (
  SELECT *, lead(start_ms) OVER (PARTITION BY conv_id, speaker ORDER BY start_ms) AS nxt FROM period
)
SELECT conv_id, speaker, 'period' AS kind, start_ms, end_ms FROM period
UNION ALL
SELECT conv_id, speaker, 'gap', end_ms, nxt FROM following WHERE nxt IS NOT NULL
"""
