"""Frame rates, labels and agreement over the data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import frames as ops
from colloquy.operators.coverage import periods_and_gaps
from colloquy.plans.base import CONV, LEN, SEG, UTT, segments, timeline, utterances, with_
from colloquy.tables import checkpointed


def _active_counts(active: DataFrame, name: str) -> DataFrame:
    return active.groupBy("conv_id", "speaker").agg(F.count("*").alias("n"), F.sum(name).alias("at_sum"))


def vad_pool_any(spark: SparkSession, d: str) -> DataFrame:
    return _active_counts(ops.pool(*timeline(spark, d), 4), "chunk")


def vad_pool_majority(spark: SparkSession, d: str) -> DataFrame:
    return _active_counts(ops.pool(*timeline(spark, d), 4, "majority"), "chunk")


def vad_resample_13hz(spark: SparkSession, d: str) -> DataFrame:
    return _active_counts(ops.resample_any(*timeline(spark, d), 13), "k")


def future_activity_label(spark: SparkSession, d: str) -> DataFrame:
    """Frames at 12.5 Hz by class of future activity, per conversation."""
    seg, length = timeline(spark, d)
    return ops.future_label_counts(seg, length.select("conv_id", F.floor(F.col("t") / 4).alias("n")), 12.5, 4)


def said_frames(spark: SparkSession, d: str) -> DataFrame:
    """Utterances as merged segments of frames."""
    u = utterances(spark, d).select("conv_id", "speaker", F.bround(F.col("s") / 20).cast("bigint").alias("i"), F.bround(F.col("e") / 20).cast("bigint").alias("j"))
    return periods_and_gaps(u, ["conv_id", "speaker"], "i", "j").where("kind = 'period'").drop("kind")


def _common(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Frames two sets of merged segments have in common, by meeting in cells of 1,000 frames."""
    cut = lambda x: x.withColumn("c", F.explode(F.sequence(F.floor(F.col("i") / 1000), F.floor((F.col("j") - 1) / 1000))))
    b = b.select(*keys, F.col("i").alias("i2"), F.col("j").alias("j2")).withColumn("c", F.explode(F.sequence(F.floor(F.col("i2") / 1000), F.floor((F.col("j2") - 1) / 1000))))
    c = F.col("c") * 1000
    n = F.least("j", "j2", c + 1000) - F.greatest("i", "i2", c)
    return cut(a).join(b, [*keys, "c"]).where(n > 0).withColumn("n", n)


def vad_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Frames of each conversation and how many are alike in what was measured and what was said, over both speakers."""
    seg, length = timeline(spark, d)
    said = checkpointed(said_frames(spark, d).join(length, "conv_id").where("i < t").withColumn("j", F.least("j", "t")).drop("t"))
    both = _common(seg, said, ["conv_id", "speaker"]).groupBy("conv_id").agg((-2 * F.sum("n")).alias("n"))
    alone = seg.unionByName(said).groupBy("conv_id").agg(F.sum(F.col("j") - F.col("i")).alias("n"))  # a segment ends within its conversation
    differ = alone.unionByName(both).groupBy("conv_id").agg(F.sum("n").alias("n"))
    x = length.where("t > 0").join(differ, "conv_id", "left")
    return x.select("conv_id", (2 * F.col("t")).alias("n_frames"), (2 * F.col("t") - F.coalesce("n", F.lit(0))).alias("n_alike"))


def channel_swap(spark: SparkSession, d: str) -> DataFrame:
    """Whether the first speaker's words lie on the other channel: conv_id, on_own, on_other, swap."""
    first = said_frames(spark, d).where("speaker = 0").select("conv_id", "i", "j")
    met = _common(segments(spark, d), first, ["conv_id"])
    x = met.groupBy("conv_id").agg(F.sum(F.when(F.col("speaker") == 0, F.col("n")).otherwise(0)).alias("on_own"), F.sum(F.when(F.col("speaker") == 1, F.col("n")).otherwise(0)).alias("on_other"))
    return x.withColumn("swap", F.col("on_other") > F.col("on_own"))


def overlap_mask(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 80 ms in which both speakers have an utterance: conv_id, chunk."""
    u = utterances(spark, d).where("s >= 0").select("conv_id", "speaker", F.explode(F.sequence(F.floor(F.col("s") / 80), F.floor(F.col("e") / 80))).alias("chunk"))
    return u.groupBy("conv_id", "chunk").agg(F.min("speaker").alias("a"), F.max("speaker").alias("b")).where("a <> b").select("conv_id", "chunk")


def nearest_onset_error(spark: SparkSession, d: str) -> DataFrame:
    """Frames from each utterance's start to the nearest segment start of the conversation: utt_id, error."""
    from colloquy.operators.asof import last_at_or_before, next_at_or_after

    u = utterances(spark, d).select("conv_id", "utt_id", F.bround(F.col("s") / 20).cast("bigint").alias("f"))
    on = segments(spark, d).select("conv_id", "i").distinct()
    x = last_at_or_before(next_at_or_after(u, on, ["conv_id"], "f", "i", "after"), on, ["conv_id"], "f", "i", "i", "before")
    return x.select("utt_id", F.least(F.col("after") - F.col("f"), F.col("f") - F.col("before")).alias("error")).where("error is not null")


FR = """act AS (SELECT DISTINCT conv_id, speaker, unnest(generate_series(i, j - 1)) AS f FROM seg)"""
SAID = """s0 AS (SELECT conv_id, speaker, CAST(round_even(s / 20, 0) AS BIGINT) AS i, CAST(round_even(e / 20, 0) AS BIGINT) AS j FROM utt),
said AS (SELECT DISTINCT conv_id, speaker, unnest(generate_series(i, j - 1)) AS f FROM s0 WHERE j > i)"""
QUERIES = {
    "vad_pool_any": vad_pool_any, "vad_pool_majority": vad_pool_majority, "vad_resample_13hz": vad_resample_13hz, "future_activity_label": future_activity_label,
    "vad_agreement": vad_agreement, "channel_swap": channel_swap, "overlap_mask": overlap_mask, "nearest_onset_error": nearest_onset_error,
}
POOL = """SELECT act.conv_id, speaker, f // 4 AS chunk, count(*) AS n FROM act JOIN len ON len.conv_id = act.conv_id WHERE f // 4 < t // 4 GROUP BY 1, 2, 3"""
SQL = {
    "vad_pool_any": with_(CONV, SEG, LEN, FR) + f"SELECT conv_id, speaker, count(*) AS n, CAST(sum(chunk) AS BIGINT) AS at_sum FROM ({POOL}) GROUP BY 1, 2",
    "vad_pool_majority": with_(CONV, SEG, LEN, FR) + f"SELECT conv_id, speaker, count(*) AS n, CAST(sum(chunk) AS BIGINT) AS at_sum FROM ({POOL}) WHERE n >= 2 GROUP BY 1, 2",
    "vad_resample_13hz": with_(CONV, SEG, LEN, FR) + """, sp AS (SELECT conv_id, t, unnest(generate_series(0, CAST(round_even(t * 13 / 50, 0) AS BIGINT) - 1)) AS k FROM len WHERE t > 0),
ed AS (SELECT *, CAST(round_even(k * 50 / 13, 0) AS BIGINT) AS a, CAST(round_even((k + 1) * 50 / 13, 0) AS BIGINT) AS b FROM sp)
SELECT conv_id, speaker, count(*) AS n, CAST(sum(k) AS BIGINT) AS at_sum FROM (SELECT DISTINCT ed.conv_id, speaker, k FROM ed JOIN seg ON seg.conv_id = ed.conv_id AND seg.i < ed.b AND seg.j > ed.a) GROUP BY 1, 2""",
    "future_activity_label": with_(CONV, SEG, LEN, FR) + f""", ch AS ({POOL}),
sp AS (SELECT conv_id, t // 4 AS n, unnest(generate_series(0, t // 4 - 1)) AS f FROM len WHERE t // 4 > 25),
x AS (SELECT sp.conv_id, sp.n, sp.f, coalesce((SELECT 1 FROM ch c WHERE c.conv_id = sp.conv_id AND c.chunk = sp.f AND c.speaker = 0), 0) AS a, coalesce((SELECT 1 FROM ch c WHERE c.conv_id = sp.conv_id AND c.chunk = sp.f AND c.speaker = 1), 0) AS b FROM sp),
y AS (SELECT conv_id, f, n, """ + " + ".join(f"(CASE WHEN 2 * sum({c}) OVER (PARTITION BY conv_id ORDER BY f ROWS BETWEEN {lo} FOLLOWING AND {hi} FOLLOWING) >= {hi - lo + 1} THEN {1 << (4 * s + k)} ELSE 0 END)" for s, c in enumerate("ab") for k, (lo, hi) in enumerate(((1, 2), (3, 7), (8, 15), (16, 25)))) + """ AS label FROM x)
SELECT conv_id, label, count(*) AS n FROM y WHERE f < n - 25 GROUP BY 1, 2""",
    "vad_agreement": with_(CONV, SEG, LEN, UTT, FR, SAID) + """, df AS (SELECT coalesce(act.conv_id, said.conv_id) AS conv_id, count(*) AS n FROM act FULL JOIN said ON act.conv_id = said.conv_id AND act.speaker = said.speaker AND act.f = said.f JOIN len ON len.conv_id = coalesce(act.conv_id, said.conv_id)
  WHERE (act.f IS NULL OR said.f IS NULL) AND coalesce(act.f, said.f) < t GROUP BY 1)
SELECT len.conv_id, 2 * t AS n_frames, 2 * t - coalesce(n, 0) AS n_alike FROM len LEFT JOIN df ON df.conv_id = len.conv_id WHERE t > 0""",
    "channel_swap": with_(SEG, UTT, FR, SAID) + """SELECT act.conv_id, CAST(sum(CASE WHEN act.speaker = 0 THEN 1 ELSE 0 END) AS BIGINT) AS on_own, CAST(sum(CASE WHEN act.speaker = 1 THEN 1 ELSE 0 END) AS BIGINT) AS on_other,
  sum(CASE WHEN act.speaker = 1 THEN 1 ELSE 0 END) > sum(CASE WHEN act.speaker = 0 THEN 1 ELSE 0 END) AS swap FROM act JOIN said ON act.conv_id = said.conv_id AND act.f = said.f AND said.speaker = 0 GROUP BY 1""",
    "overlap_mask": with_(UTT) + """, c AS (SELECT conv_id, speaker, unnest(generate_series(s // 80, e // 80)) AS chunk FROM utt WHERE s >= 0)
SELECT conv_id, chunk FROM c GROUP BY 1, 2 HAVING count(DISTINCT speaker) = 2""",
    "nearest_onset_error": with_(SEG, UTT) + """SELECT utt_id, min(abs(CAST(round_even(s / 20, 0) AS BIGINT) - i)) AS error FROM utt JOIN seg ON seg.conv_id = utt.conv_id GROUP BY 1""",
}
