"""Turn events and what is derived from activity segments, over the data set."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.operators import events as ops
from colloquy.plans.base import CONV, LEN, SEG, segments, timeline, with_
from colloquy.schema import onset_edges

PAUSE, AHEAD, SHORT, TOLERATED, RESUME = 10, 150, 50, 25, 50  # frames at 50 Hz


def events(spark: SparkSession, d: str) -> DataFrame:
    """Turn events of all conversations."""
    return ops.turn_events(*timeline(spark, d))


def segment_islands(spark: SparkSession, d: str) -> DataFrame:
    """Merged activity segments in frames."""
    return segments(spark, d)


def turn_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often turns are handed over, held, interrupted or back-channelled."""
    return events(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


def onset_min_gap(spark: SparkSession, d: str) -> DataFrame:
    return ops.onsets(segments(spark, d), PAUSE)


def next_onset_bins(spark: SparkSession, d: str) -> DataFrame:
    seg, length = timeline(spark, d)
    return ops.onset_bin_counts(ops.onsets(seg, PAUSE), length, onset_edges(50), 128)


def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    seg, length = timeline(spark, d)
    return ops.quality_flags(seg, length, ops.turn_events(seg, length))


def remove_short_runs(spark: SparkSession, d: str) -> DataFrame:
    return ops.remove_short(*timeline(spark, d), 10, 5)


def overlap_stats(spark: SparkSession, d: str) -> DataFrame:
    """Frames active of each speaker, of both at once and of either, per conversation."""
    edges = segments(spark, d).select("conv_id", F.explode(F.array(F.struct(F.col("i").alias("f"), F.lit(1).alias("v"), "speaker"), F.struct(F.col("j").alias("f"), F.lit(-1).alias("v"), "speaker"))).alias("x")).select("conv_id", "x.*")
    at = edges.groupBy("conv_id", "f").agg(F.sum(F.when(F.col("speaker") == 0, F.col("v")).otherwise(0)).alias("d0"), F.sum(F.when(F.col("speaker") == 1, F.col("v")).otherwise(0)).alias("d1"))
    w = Window.partitionBy("conv_id").orderBy("f")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    lev = at.select("conv_id", (F.lead("f").over(w) - F.col("f")).alias("n"), F.sum("d0").over(run).alias("a"), F.sum("d1").over(run).alias("b"))
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return lev.groupBy("conv_id").agg(part(F.col("a") > 0)("n_a"), part(F.col("b") > 0)("n_b"), part((F.col("a") > 0) & (F.col("b") > 0))("n_both"), part((F.col("a") > 0) | (F.col("b") > 0))("n_either"))


EVENTS_CTE = f"""own AS (SELECT *, lead(i) OVER (PARTITION BY conv_id, speaker ORDER BY i) AS ns FROM seg),
x AS (SELECT own.*, len.t,
    (SELECT min(o.i) FROM seg o WHERE o.conv_id = own.conv_id AND o.speaker = 1 - own.speaker AND o.i >= own.j) AS next_o,
    (SELECT count(*) FROM seg o WHERE o.conv_id = own.conv_id AND o.speaker = 1 - own.speaker AND o.i <= own.j - 1 AND o.j > own.j - 1) AS covered,
    (SELECT max(o.j) FROM seg o WHERE o.conv_id = own.conv_id AND o.speaker = 1 - own.speaker AND o.i <= own.i AND o.j > own.i) AS oe
  FROM own JOIN len ON len.conv_id = own.conv_id),
y AS (SELECT x.*, (SELECT min(o.i) FROM seg o WHERE o.conv_id = x.conv_id AND o.speaker = 1 - x.speaker AND o.i >= x.oe) AS o_res FROM x),
ev AS (
  SELECT conv_id, j AS f, speaker, CASE WHEN next_o < j + {AHEAD} AND (ns IS NULL OR ns >= j + {AHEAD} OR next_o < ns) THEN 'SHIFT' ELSE 'HOLD' END AS kind
  FROM y WHERE j + {PAUSE} <= t AND (ns IS NULL OR ns - j >= {PAUSE}) AND covered = 0
  UNION ALL
  SELECT conv_id, CASE WHEN oe - i <= {TOLERATED} AND j > oe AND NOT coalesce(o_res < oe + {RESUME}, false) THEN oe ELSE i END,
    CASE WHEN oe - i <= {TOLERATED} AND j > oe AND NOT coalesce(o_res < oe + {RESUME}, false) THEN 1 - speaker ELSE speaker END,
    CASE WHEN oe - i <= {TOLERATED} AND j > oe AND NOT coalesce(o_res < oe + {RESUME}, false) THEN 'SHIFT'
         WHEN j > oe AND NOT coalesce(o_res < oe + {RESUME}, false) THEN 'INTERRUPT' ELSE 'BACKCHANNEL' END
  FROM y WHERE i > 0 AND oe IS NOT NULL AND ((j > oe AND NOT coalesce(o_res < oe + {RESUME}, false)) OR j - i <= {SHORT}))"""
HEAD = partial(with_, CONV, SEG, LEN)
ONSET = "ons AS (SELECT conv_id, speaker, i FROM (SELECT *, lag(j) OVER (PARTITION BY conv_id, speaker ORDER BY i) AS pj2 FROM seg) WHERE pj2 IS NULL OR pj2 <= i - 10)"

QUERIES = {
    "segment_islands": segment_islands, "turn_events": events, "turn_event_counts": turn_event_counts, "onset_min_gap": onset_min_gap,
    "next_onset_bins": next_onset_bins, "quality_flags": quality_flags, "remove_short_runs": remove_short_runs, "overlap_stats": overlap_stats,
}
SQL = {
    "segment_islands": with_(SEG) + "SELECT * FROM seg",
    "turn_events": HEAD(EVENTS_CTE) + "SELECT conv_id, f, speaker, kind FROM ev",
    "turn_event_counts": HEAD(EVENTS_CTE) + "SELECT kind, count(*) AS n FROM ev GROUP BY 1",
    "onset_min_gap": with_(SEG, ONSET) + "SELECT * FROM ons",
    "next_onset_bins": HEAD(ONSET) + """, fr AS (SELECT conv_id, sp.speaker, unnest(generate_series(0, t - 1)) AS f FROM len, (VALUES (0), (1)) sp(speaker)),
tagged AS (SELECT conv_id, speaker, f AS pos, 1 AS is_frame, NULL AS o FROM fr UNION ALL SELECT conv_id, speaker, i, 0, i FROM ons),
tau AS (SELECT *, min(o) OVER (PARTITION BY conv_id, speaker ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - pos AS d FROM tagged)
SELECT conv_id, speaker, CASE WHEN d IS NULL OR d > 128 THEN 5 ELSE (d >= 8)::INT + (d >= 16)::INT + (d >= 32)::INT + (d >= 64)::INT + (d >= 128)::INT END AS bin,
  (d IS NULL OR d > 128) AS censored, count(*) AS n FROM tau WHERE is_frame = 1 GROUP BY 1, 2, 3, 4""",
    "quality_flags": HEAD(EVENTS_CTE) + """, r AS (SELECT len.conv_id, min(coalesce(n, 0) / greatest(t, 1)) AS least, any_value(t) AS t
  FROM len CROSS JOIN (VALUES (0), (1)) sp(speaker) LEFT JOIN (SELECT conv_id, speaker, sum(j - i) AS n FROM seg GROUP BY 1, 2) a ON a.conv_id = len.conv_id AND a.speaker = sp.speaker GROUP BY 1)
SELECT conv_id, 'one_channel_silent' AS flag FROM r WHERE least < 0.05 UNION ALL SELECT conv_id, 'too_short' FROM r WHERE t < 1500
UNION ALL SELECT conv_id, 'no_events' FROM r WHERE conv_id NOT IN (SELECT conv_id FROM ev)""",
    "remove_short_runs": HEAD() + """, w AS (SELECT seg.*, t, lag(j) OVER p AS b, lead(i) OVER p AS a FROM seg JOIN len ON len.conv_id = seg.conv_id WINDOW p AS (PARTITION BY seg.conv_id, speaker ORDER BY i)),
k AS (SELECT *, sum(CASE WHEN b IS NOT NULL AND i - b < 10 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, speaker ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM w)
SELECT conv_id, speaker, i, j FROM (SELECT conv_id, speaker, run, min(CASE WHEN b IS NULL AND i < 10 THEN 0 ELSE i END) AS i, max(CASE WHEN a IS NULL AND t - j < 10 THEN greatest(t, j) ELSE j END) AS j FROM k GROUP BY 1, 2, 3) WHERE j - i >= 5""",
    "overlap_stats": with_(SEG) + """, n AS (SELECT conv_id, sum(CASE WHEN speaker = 0 THEN j - i ELSE 0 END) AS n_a, sum(CASE WHEN speaker = 1 THEN j - i ELSE 0 END) AS n_b FROM seg GROUP BY 1),
o AS (SELECT a.conv_id, sum(least(a.j, b.j) - greatest(a.i, b.i)) AS n_both FROM seg a JOIN seg b ON a.conv_id = b.conv_id AND a.speaker = 0 AND b.speaker = 1 AND a.i < b.j AND b.i < a.j GROUP BY 1)
SELECT n.conv_id, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, CAST(coalesce(n_both, 0) AS BIGINT) AS n_both, CAST(n_a + n_b - coalesce(n_both, 0) AS BIGINT) AS n_either FROM n LEFT JOIN o ON o.conv_id = n.conv_id""",
}
