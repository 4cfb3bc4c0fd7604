"""Windows, splits and filters over the data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import windows as ops
from colloquy.operators.events import turn_events
from colloquy.plans import events as ev
from colloquy.plans.base import CONV, LEN, SEG, UTT, conversations, lengths, utterances, with_

WINDOW, HOP = 1000, 500  # frames: 20 s and 10 s


def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return ops.sliding_windows(lengths(spark, d), WINDOW, HOP)


def silent_starts(spark: SparkSession, d: str) -> DataFrame:
    return ops.silent_starts(utterances(spark, d).select("conv_id", "s", "e"), 20_000, 1000, 500)


def window_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Windows without a laughing utterance."""
    laughs = utterances(spark, d, "label").where("label = 'Laughter'").select("conv_id", F.bround(F.col("s") / 20).cast("bigint").alias("s"), F.bround(F.col("e") / 20).cast("bigint").alias("e"))
    return ops.drop_touched(sliding_windows(spark, d), laughs, WINDOW, HOP)


def event_window_slice(spark: SparkSession, d: str) -> DataFrame:
    seg, length = ev.timeline(spark, d)
    return ops.slice_events(ops.sliding_windows(length, WINDOW, HOP), turn_events(seg, length), WINDOW, HOP)


def split_train_val(spark: SparkSession, d: str) -> DataFrame:
    return ops.split_last(conversations(spark, d), "conv_id", 0.08)


def cumulative_hours(spark: SparkSession, d: str) -> DataFrame:
    """The first conversations in order of id, up to ten hours."""
    rows = conversations(spark, d).where("ms is not null").groupBy("conv_id").agg(F.max("ms").alias("ms"))
    return ops.cumulative_limit(rows, "conv_id", "ms", 36_000_000)


def sample_per_conversation(spark: SparkSession, d: str) -> DataFrame:
    return ops.sample_per_group(utterances(spark, d).select("conv_id", "utt_id"), "conv_id", "utt_id", 3)


WIN = f"win AS (SELECT conv_id, CAST(k AS INT) AS win, CAST(k * {HOP} AS BIGINT) AS start FROM (SELECT conv_id, unnest(generate_series(0, (t - {WINDOW}) // {HOP})) AS k FROM len WHERE t >= {WINDOW}))"
QUERIES = {
    "sliding_windows": sliding_windows, "silent_starts": silent_starts, "window_exclusion": window_exclusion, "event_window_slice": event_window_slice,
    "split_train_val": split_train_val, "cumulative_hours": cumulative_hours, "sample_per_conversation": sample_per_conversation,
}
SQL = {
    "sliding_windows": with_(CONV, SEG, LEN, WIN) + "SELECT * FROM win",
    "silent_starts": with_(UTT) + """, top AS (SELECT conv_id, max(e) AS e FROM utt GROUP BY 1),
grid AS (SELECT conv_id, unnest(generate_series(0, (e - 20000) // 1000)) * 1000 AS start FROM top WHERE e >= 20000)
SELECT conv_id, CAST(start AS BIGINT) AS start FROM grid g WHERE NOT EXISTS (SELECT 1 FROM utt u WHERE u.conv_id = g.conv_id AND u.s - 500 <= g.start AND g.start < u.e + 500)""",
    "window_exclusion": with_(CONV, SEG, LEN, WIN, UTT) + f"""SELECT * FROM win w WHERE NOT EXISTS (SELECT 1 FROM utt u WHERE u.conv_id = w.conv_id AND label = 'Laughter'
  AND round_even(u.s / 20, 0) < w.start + {WINDOW} AND round_even(u.e / 20, 0) > w.start)""",
    "event_window_slice": ev.HEAD(ev.EVENTS_CTE, WIN) + f"SELECT w.conv_id, win, f - start AS f, speaker, kind FROM win w JOIN ev ON ev.conv_id = w.conv_id AND ev.f >= w.start AND ev.f < w.start + {WINDOW}",
    "split_train_val": with_(CONV) + """, k AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conv))
SELECT conv_id, CASE WHEN r > n - greatest(1, CAST(floor(n * 0.08) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM k""",
    "cumulative_hours": with_(CONV) + """, one AS (SELECT conv_id, max(ms) AS ms FROM conv WHERE ms IS NOT NULL GROUP BY 1)
SELECT conv_id, ms FROM (SELECT *, coalesce(sum(ms) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM one) WHERE b < 36000000""",
    "sample_per_conversation": with_(UTT) + "SELECT conv_id, utt_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY (utt_id * 7919) % 100003, utt_id) AS k FROM utt) WHERE k <= 3",
}
