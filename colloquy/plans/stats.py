"""Corpus statistics over the data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import stats as ops
from colloquy.plans.base import CONV, SEG, UTT, conversations, segments, utterances, with_
from colloquy.plans.events import HEAD
from colloquy.tables import table

EDGES = [0, 200, 500, 1000, 2000]  # ms


def turn_gaps(spark: SparkSession, d: str) -> DataFrame:
    return ops.turn_gaps(utterances(spark, d))


def gap_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ops.histogram(turn_gaps(spark, d), "gap", EDGES)


def turn_stats_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Gaps and overlaps summed up, in seconds."""
    g = turn_gaps(spark, d).select(F.when(F.col("gap") >= 0, "gap").otherwise("overlap").alias("what"), (F.abs("gap") / 1000).alias("v"))
    return g.groupBy("what").agg(*ops.quantile_summary("v"))


def overlap_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Share of overlaps among changes of speaker, per source as written."""
    g = turn_gaps(spark, d).join(conversations(spark, d).select("conv_id", "source"), "conv_id")
    return g.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("gap") < 0, 1.0).otherwise(0.0)), 6).alias("ratio"))


def corpus_value_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each value of several columns occurs."""
    c = table(spark, d, "conversation").select("id", "vad_source", F.col("meta")["noise"].alias("noise"), F.col("meta")["domain"].alias("domain")).distinct()
    x = c.select(F.explode(F.array(*(F.struct(F.lit(k).alias("what"), F.col(k).alias("value")) for k in ("vad_source", "noise", "domain")))).alias("x")).select("x.*")
    return x.groupBy("what", "value").agg(F.count("*").alias("n"))


def top_domains(spark: SparkSession, d: str) -> DataFrame:
    """The twelve domains with the most conversations."""
    return conversations(spark, d).where("domain is not null").groupBy("domain").agg(F.countDistinct("conv_id").alias("n")).orderBy(F.desc("n"), "domain").limit(12)


def build_summary(spark: SparkSession, d: str) -> DataFrame:
    """Hours, speech ratio and segments per source as written."""
    speech = segments(spark, d).groupBy("conv_id").agg(F.sum(F.col("j") - F.col("i")).alias("n"), F.count("*").alias("k"))
    x = conversations(spark, d).where("ms is not null").join(speech, "conv_id", "left")
    ratio = F.coalesce("n", F.lit(0)) * 20 / (2 * F.col("ms"))
    return x.groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("ms") / 3_600_000, 6).alias("hours"), F.round(F.avg(ratio), 6).alias("speech_ratio"), F.sum(F.coalesce("k", F.lit(0))).alias("n_segments"))


def cache_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Conversations and hours per source and voice-activity source, with subtotals and a grand total."""
    c = table(spark, d, "conversation").select("id", "source", "vad_source", F.round(F.col("duration") * 1000).cast("bigint").alias("ms")).where("ms > 0").distinct()
    return c.rollup("source", "vad_source").agg(F.count("*").alias("n"), F.sum("ms").alias("ms"), F.grouping_id().alias("level"))


def timestamp_decimals(spark: SparkSession, d: str) -> DataFrame:
    """Decimals of the raw start times."""
    r = table(spark, d, "raw_utterance").select("raw_id", "start_time").distinct()
    return r.groupBy(F.length(F.regexp_extract("start_time", r"[.,]([0-9]+)$", 1)).alias("decimals")).agg(F.count("*").alias("n"))


def label_number_parse(spark: SparkSession, d: str) -> DataFrame:
    """Raw start times that are plain numbers, thousands separators taken away."""
    r = table(spark, d, "raw_utterance").where(r"start_time rlike '^[0-9][0-9,]*[.][0-9]+$'").select("raw_id", "start_time").distinct()
    return r.select("raw_id", F.round(F.expr("try_cast(regexp_replace(start_time, ',', '') AS double)"), 3).alias("seconds"))


GAPS = """gp AS (SELECT conv_id, s AS at, s - pe AS gap FROM (SELECT *, lag(speaker) OVER w AS ps, lag(e) OVER w AS pe FROM utt WINDOW w AS (PARTITION BY conv_id ORDER BY s, e, utt_id)) WHERE ps <> speaker)"""
QUERIES = {
    "turn_gaps": turn_gaps, "gap_histogram": gap_histogram, "turn_stats_quantiles": turn_stats_quantiles, "overlap_ratio": overlap_ratio, "corpus_value_counts": corpus_value_counts,
    "top_domains": top_domains, "build_summary": build_summary, "cache_rollup": cache_rollup, "timestamp_decimals": timestamp_decimals, "label_number_parse": label_number_parse,
}
SQL = {
    "turn_gaps": with_(UTT, GAPS) + "SELECT * FROM gp",
    "gap_histogram": with_(UTT, GAPS) + "SELECT b.bin, count(gap) AS n FROM (VALUES (0), (1), (2), (3), (4)) b(bin) LEFT JOIN gp ON gap >= 0 AND b.bin = CASE WHEN gap < 200 THEN 0 WHEN gap < 500 THEN 1 WHEN gap < 1000 THEN 2 WHEN gap < 2000 THEN 3 ELSE 4 END GROUP BY 1",
    "turn_stats_quantiles": with_(UTT, GAPS) + """SELECT what, count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90, max(v) AS max
FROM (SELECT CASE WHEN gap >= 0 THEN 'gap' ELSE 'overlap' END AS what, abs(gap) / 1000 AS v FROM gp) GROUP BY 1""",
    "overlap_ratio": with_(CONV, UTT, GAPS) + "SELECT source, count(*) AS n, round(avg(CASE WHEN gap < 0 THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM gp JOIN conv ON conv.conv_id = gp.conv_id GROUP BY 1",
    "corpus_value_counts": """WITH c AS (SELECT DISTINCT id, vad_source, meta['noise'] AS noise, meta['domain'] AS domain FROM conversation)
SELECT 'vad_source' AS what, vad_source AS value, count(*) AS n FROM c GROUP BY 1, 2 UNION ALL SELECT 'noise', noise, count(*) FROM c GROUP BY 1, 2 UNION ALL SELECT 'domain', domain, count(*) FROM c GROUP BY 1, 2""",
    "top_domains": with_(CONV) + "SELECT domain, count(DISTINCT conv_id) AS n FROM conv WHERE domain IS NOT NULL GROUP BY 1 ORDER BY n DESC, domain LIMIT 12",
    "build_summary": with_(CONV, SEG) + """SELECT source, count(*) AS n, round(sum(ms) / 3600000, 6) AS hours, round(avg(coalesce(f, 0) * 20 / (2 * ms)), 6) AS speech_ratio, CAST(sum(coalesce(k, 0)) AS BIGINT) AS n_segments
FROM conv LEFT JOIN (SELECT conv_id, sum(j - i) AS f, count(*) AS k FROM seg GROUP BY 1) s ON s.conv_id = conv.conv_id WHERE ms IS NOT NULL GROUP BY 1""",
    "cache_rollup": """WITH c AS (SELECT DISTINCT id, source, vad_source, CAST(round(duration * 1000) AS BIGINT) AS ms FROM conversation WHERE round(duration * 1000) > 0)
SELECT source, vad_source, count(*) AS n, CAST(sum(ms) AS BIGINT) AS ms, grouping(source, vad_source) AS level FROM c GROUP BY ROLLUP (source, vad_source)""",
    "timestamp_decimals": "SELECT length(regexp_extract(start_time, '[.,]([0-9]+)$', 1)) AS decimals, count(*) AS n FROM (SELECT DISTINCT raw_id, start_time FROM raw_utterance) GROUP BY 1",
    "label_number_parse": "SELECT raw_id, round(CAST(replace(start_time, ',', '') AS DOUBLE), 3) AS seconds FROM (SELECT DISTINCT raw_id, start_time FROM raw_utterance) WHERE regexp_full_match(start_time, '[0-9][0-9,]*[.][0-9]+')",
}
