"""Detection scores over the data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import scoring as ops
from colloquy.operators.stats import best_within_budgets
from colloquy.plans import events as ev
from colloquy.plans.base import CONV, SEG, UTT, conversations, segments, utterances, with_
from colloquy.plans.frames import FR, SAID, _common, said_frames
from colloquy.schema import BACKCHANNEL_LABELS
from colloquy.tables import checkpointed

GRID = list(range(0, 21))
BUDGETS = [0.045, 0.06, 0.08, 0.10, 0.5]


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Short utterances score high as back-channels; run: speaker, delay: length."""
    n = F.least(F.col("e") - F.col("s"), F.lit(2000))
    return utterances(spark, d, "label").where("label is not null").select("speaker", F.floor((2000 - n) / 100).cast("int").alias("score"), F.col("label").isin(*BACKCHANNEL_LABELS).alias("gold"), (F.col("e") - F.col("s")).cast("double").alias("delay"))


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return ops.threshold_sweep(_scored(spark, d), "speaker", GRID, 20)


def best_at_budget(spark: SparkSession, d: str) -> DataFrame:
    return best_within_budgets(threshold_sweep(spark, d), "speaker", BUDGETS)


def operating_point(spark: SparkSession, d: str) -> DataFrame:
    return best_within_budgets(threshold_sweep(spark, d), "speaker", [0.1]).drop("budget")


def masked_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Frame-wise precision, recall and F1 of measured against said activity, per source as written."""
    seg, said = checkpointed(segments(spark, d)), checkpointed(said_frames(spark, d))
    total = lambda x, n: x.groupBy("conv_id").agg(F.sum(F.col("j") - F.col("i")).alias(n))
    both = _common(seg, said, ["conv_id", "speaker"]).groupBy("conv_id").agg(F.sum("n").alias("tp"))
    x = conversations(spark, d).select("conv_id", "source").distinct().join(total(seg, "p"), "conv_id", "left").join(total(said, "t"), "conv_id", "left").join(both, "conv_id", "left")
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return x.groupBy("source").agg(s("tp").alias("tp"), s("p").alias("p"), s("t").alias("t"), F.round(2 * s("tp") / F.greatest(s("p") + s("t"), F.lit(1)), 6).alias("f1"))


def event_match_score(spark: SparkSession, d: str) -> DataFrame:
    """Handed-over turns found by utterance ends, -0.25 s to +3 s: gold, hits, delay quantiles in frames."""
    gold = ev.events(spark, d).where("kind = 'SHIFT'").select("conv_id", "speaker", F.col("f").alias("at"))
    pred = utterances(spark, d).select("conv_id", "speaker", F.bround(F.col("e") / 20).cast("bigint").alias("at"))
    m = ops.match_events(gold, pred, ["conv_id", "speaker"], 12, 150)
    lat = F.col("hit") - F.col("at")
    return m.agg(F.count("*").alias("gold"), F.count("hit").alias("hits"), *(F.round(F.percentile(lat, F.lit(q)), 3).alias(f"p{int(100 * q)}") for q in (0.1, 0.5, 0.9)))


SWEEP = """sx AS (SELECT speaker, CAST((2000 - least(e - s, 2000)) // 100 AS INT) AS score, label IN ('Acknowledgement Backchannel', 'Continuer Backchannel') AS gold, CAST(e - s AS DOUBLE) AS delay FROM utt WHERE label IS NOT NULL),
sw AS (SELECT speaker, t / 20 AS theta, round(count(*) FILTER (gold AND score >= t) / nullif(count(*) FILTER (gold), 0), 6) AS recall, round(count(*) FILTER (NOT gold AND score >= t) / nullif(count(*) FILTER (NOT gold), 0), 6) AS fp_rate,
  round(quantile_cont(delay, 0.5) FILTER (gold AND score >= t), 3) AS lat_p50 FROM sx CROSS JOIN (SELECT unnest(generate_series(0, 20)) AS t) GROUP BY speaker, t)"""
BEST = "SELECT {0} theta, recall, fp_rate, lat_p50 FROM (SELECT sw.*, b AS budget, row_number() OVER (PARTITION BY speaker, b ORDER BY recall DESC, coalesce(lat_p50, 1e18), theta) AS k FROM sw JOIN (VALUES {1}) bb(b) ON fp_rate <= b WHERE recall IS NOT NULL) WHERE k = 1"
QUERIES = {"threshold_sweep": threshold_sweep, "best_at_budget": best_at_budget, "operating_point": operating_point, "masked_metrics": masked_metrics, "event_match_score": event_match_score}
SQL = {
    "threshold_sweep": with_(UTT, SWEEP) + "SELECT * FROM sw",
    "best_at_budget": with_(UTT, SWEEP) + BEST.format("speaker, CAST(budget AS DOUBLE) AS budget,", ", ".join(f"({b})" for b in BUDGETS)),
    "operating_point": with_(UTT, SWEEP) + BEST.format("speaker,", "(0.1)"),
    "masked_metrics": with_(CONV, SEG, UTT, FR, SAID) + """, p AS (SELECT conv_id, count(*) AS p FROM act GROUP BY 1), t AS (SELECT conv_id, count(*) AS t FROM said GROUP BY 1),
b AS (SELECT act.conv_id, count(*) AS tp FROM act JOIN said USING (conv_id, speaker, f) GROUP BY 1), c AS (SELECT DISTINCT conv_id, source FROM conv)
SELECT source, CAST(coalesce(sum(tp), 0) AS BIGINT) AS tp, CAST(coalesce(sum(p), 0) AS BIGINT) AS p, CAST(coalesce(sum(t), 0) AS BIGINT) AS t, round(2 * coalesce(sum(tp), 0) / greatest(coalesce(sum(p), 0) + coalesce(sum(t), 0), 1), 6) AS f1
FROM c LEFT JOIN p ON p.conv_id = c.conv_id LEFT JOIN t ON t.conv_id = c.conv_id LEFT JOIN b ON b.conv_id = c.conv_id GROUP BY 1""",
}
