"""Emission schedules over the data set: words are tokens that end evenly spread over their utterance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import interleave as ops
from colloquy.plans.base import UTT, utterances, with_
from colloquy.tables import checkpointed


TOKENS = 1000  # token ids of one utterance; one with more words is an error, not another's id


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, utt_id, speaker, tid, pos, end_ms, word."""
    u = utterances(spark, d, "text").where("text is not null").withColumn("w", F.filter(F.split("text", " "), lambda x: x != ""))
    return timed(u.select("conv_id", "utt_id", "speaker", "s", "e", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word")), "word")


def timed(x: DataFrame, *extra: str) -> DataFrame:
    """conv_id, utt_id, speaker, tid, pos, end_ms and ``extra`` columns, from the words' places ``pos`` and their number ``n`` in the utterance."""
    end = F.col("s") + F.floor((F.col("pos") + 1) * (F.col("e") - F.col("s")) / F.col("n"))
    return x.select("conv_id", "utt_id", "speaker", (F.col("utt_id") * TOKENS + F.when(F.col("pos") < TOKENS, F.col("pos")).otherwise(F.raise_error(F.lit("too many words in an utterance")).cast("int"))).alias("tid"), "pos", end.cast("bigint").alias("end_ms"), *extra)


def streams(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Tokens, and the length of each conversation (its last utterance's end)."""
    return tokens(spark, d), utterances(spark, d).groupBy("conv_id").agg(F.max("e").alias("ms"))


def interleave_emissions(spark: SparkSession, d: str) -> DataFrame:
    t, n = streams(spark, d)
    return ops.speaker_tags(ops.schedule(t, n, 4, 2)).select("conv_id", "tid", "b", "e", F.col("tag"))


def interleave_stats(spark: SparkSession, d: str) -> DataFrame:
    t, n = streams(spark, d)
    return ops.emission_stats(ops.schedule(t, n, 4, 2), n).drop("m")


def interleave_budget_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Overflow and backlog for one to four tokens a chunk."""
    t, n = streams(spark, d)
    each = t.withColumn("m", F.explode(F.array(*(F.lit(i) for i in range(1, 5)))))
    s = ops.emission_stats(ops.schedule(each, n, None, 2), n)
    return s.groupBy("m").agg(F.sum("tokens").alias("tokens"), F.sum("overflow_tokens").alias("overflow_tokens"), F.max("max_backlog").alias("max_backlog"))


def emission_histogram(spark: SparkSession, d: str) -> DataFrame:
    t, n = streams(spark, d)
    return ops.chunk_histogram(ops.schedule(t, n, 4, 2), n).drop("m")


def model_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Per conversation: items of each kind in the model sequence, the sum of their positions and of position times label.

    ``check_sum`` is a bigint, as in the SQL, if every one fits; if not (ids of over some 10^7 in long conversations), where the SQL fails, all are decimals.
    Utterances are exchanged, with the number of their words; tokens are made behind the exchange.
    """
    length = utterances(spark, d).groupBy("conv_id").agg(F.max("e").alias("ms"))
    words = F.size(F.filter(F.split("text", " "), lambda x: x != ""))
    u = utterances(spark, d, "text").where("text is not null").select("conv_id", "utt_id", "speaker", "s", "e", words.alias("n")).where("n > 0")
    u = u.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id").join(ops.chunk_counts(length), "conv_id")  # not coalesced by the size of what isn't yet made
    t = timed(u.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n") - 1))), "n_chunks")
    sums = checkpointed(ops.sequence_sums(ops.schedule(t, None, 4, 2), length))
    narrow = F.expr("try_cast(check_sum as bigint)")
    return sums.withColumn("check_sum", narrow) if sums.where(narrow.isNull() & F.col("check_sum").isNotNull()).isEmpty() else sums


def bad_utterances(spark: SparkSession, d: str) -> DataFrame:
    return ops.bad_utterances(utterances(spark, d), tokens(spark, d))


def align_qc_report(spark: SparkSession, d: str) -> DataFrame:
    """Utterances and tokens by reason of rejection."""
    n = tokens(spark, d).groupBy("utt_id").agg(F.count("*").alias("n"))
    x = utterances(spark, d).select("utt_id").join(n, "utt_id", "left").join(bad_utterances(spark, d), "utt_id", "left")
    return x.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n_utts"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"))


def token_rate(spark: SparkSession, d: str) -> DataFrame:
    """Token rates of utterances: quantiles and the share above the rates of one to four tokens a chunk."""
    n = tokens(spark, d).groupBy("utt_id").agg(F.count("*").alias("n"))
    r = utterances(spark, d).join(n, "utt_id").select((F.col("n") * 1000 / F.greatest(F.col("e") - F.col("s"), F.lit(100))).alias("r"), "n")
    over = [F.round(F.avg(F.when(F.col("r") > x, 1.0).otherwise(0.0)), 6).alias(f"over_{k}") for k, x in enumerate((12.5, 25, 37.5, 50), 1)]
    return r.agg(F.count("*").alias("n"), *(F.round(F.percentile("r", F.lit(p)), 6).alias(f"p{int(100 * p)}") for p in (0.5, 0.9, 0.99)), *over)


TOK = """tok AS (SELECT conv_id, utt_id, speaker, utt_id * 1000 + pos AS tid, pos, s + ((pos + 1) * (e - s)) // len(w) AS end_ms, w[pos + 1] AS word
  FROM (SELECT *, unnest(generate_series(0, len(w) - 1)) AS pos FROM (SELECT *, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM utt WHERE text IS NOT NULL) WHERE len(w) > 0)),
ln AS (SELECT conv_id, CAST(ceil(max(e) / 80) AS BIGINT) AS n_chunks FROM utt GROUP BY 1)"""


def sched(ms: str) -> str:
    return f"""bk AS (SELECT tok.*, m, n_chunks, least(n_chunks, end_ms // 80 + 2) AS b FROM tok JOIN ln ON ln.conv_id = tok.conv_id CROSS JOIN (VALUES {ms}) mm(m)),
rk AS (SELECT *, row_number() OVER (PARTITION BY conv_id, m ORDER BY end_ms, speaker, tid) - 1 AS i FROM bk WHERE b < n_chunks),
sc AS (SELECT *, i // m + max(b - i // m) OVER (PARTITION BY conv_id, m, i % m ORDER BY i // m ROWS UNBOUNDED PRECEDING) AS e FROM rk)"""


STATS = """mv AS (SELECT conv_id, m, b AS k, 1 AS v FROM sc UNION ALL SELECT conv_id, m, least(e, n_chunks), -1 FROM sc),
lv AS (SELECT conv_id, m, sum(v) OVER (PARTITION BY conv_id, m ORDER BY k ROWS UNBOUNDED PRECEDING) AS l FROM (SELECT conv_id, m, k, sum(v) AS v FROM mv GROUP BY 1, 2, 3)),
st AS (SELECT a.*, x.max_backlog FROM (SELECT conv_id, m, any_value(n_chunks) AS chunks, count(*) FILTER (e < n_chunks) AS tokens, CAST(sum(least(e, n_chunks) - b) AS BIGINT) AS overflow_tokens, count(*) FILTER (least(e, n_chunks) > b) AS distinct_overflow FROM sc GROUP BY 1, 2) a
  JOIN (SELECT conv_id, m, CAST(max(l) AS BIGINT) AS max_backlog FROM lv GROUP BY 1, 2) x ON x.conv_id = a.conv_id AND x.m = a.m)"""
BAD = """sm AS (SELECT utt_id, max(k) AS same, sum(k) AS n FROM (SELECT utt_id, end_ms, count(*) AS k FROM tok GROUP BY 1, 2) GROUP BY 1),
bad AS (SELECT * FROM (SELECT utt.utt_id, CASE WHEN n IS NULL THEN 'empty' WHEN same > 8 THEN 'same_time' WHEN n * 1000 > 25 * greatest(e - s, 100) THEN 'rate' END AS reason FROM utt LEFT JOIN sm ON sm.utt_id = utt.utt_id) WHERE reason IS NOT NULL)"""
TAG = "tg AS (SELECT *, (e < n_chunks AND (lag(speaker) OVER w IS NULL OR lag(speaker) OVER w <> speaker)) AS tag FROM sc WINDOW w AS (PARTITION BY conv_id, m ORDER BY i))"
def token_char_span_align(spark: SparkSession, d: str) -> DataFrame:
    """Ends of the tokens of each utterance, pieces of four characters, from the ends of its words."""
    words = tokens(spark, d).groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "end_ms"))).alias("items"))
    u = utterances(spark, d, "text").select("utt_id", "text").where("text <> ''")
    n = F.length("text")
    pieces = F.transform(F.sequence(F.lit(0), n - 1, F.lit(4)), lambda a: F.struct(a.alias("a"), F.least(a + 4, n).alias("b")))
    return ops.token_char_span_align(u.join(words, "utt_id").withColumn("tokens", pieces), "utt_id")


QUERIES = {
    "interleave_emissions": interleave_emissions, "interleave_stats": interleave_stats, "interleave_budget_sweep": interleave_budget_sweep, "emission_histogram": emission_histogram,
    "model_sequence": model_sequence, "bad_utterances": bad_utterances, "align_qc_report": align_qc_report, "token_rate": token_rate, "token_char_span_align": token_char_span_align,
}
SQL = {
    "interleave_emissions": with_(UTT, TOK, sched("(4)"), TAG) + "SELECT conv_id, tid, b, e, tag FROM tg",
    "interleave_stats": with_(UTT, TOK, sched("(4)"), STATS) + "SELECT conv_id, chunks, tokens, overflow_tokens, distinct_overflow, max_backlog FROM st",
    "interleave_budget_sweep": with_(UTT, TOK, sched("(1), (2), (3), (4)"), STATS) + "SELECT m, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(overflow_tokens) AS BIGINT) AS overflow_tokens, max(max_backlog) AS max_backlog FROM st GROUP BY 1",
    "emission_histogram": with_(UTT, TOK, sched("(4)")) + """, f AS (SELECT conv_id, e, count(*) AS n_tokens FROM sc WHERE e < n_chunks GROUP BY 1, 2)
SELECT n_tokens, count(*) AS n FROM f GROUP BY 1 UNION ALL SELECT 0, CAST((SELECT sum(n_chunks) FROM (SELECT DISTINCT conv_id, n_chunks FROM sc)) AS BIGINT) - count(*) FROM f""",
    "model_sequence": with_(UTT, TOK, sched("(4)"), TAG) + """, sp AS (SELECT conv_id, unnest(generate_series(0, n_chunks - 1)) AS chunk FROM ln),
it AS (SELECT conv_id, chunk, 0 AS o, 0 AS i, 'audio' AS kind, -100 AS label FROM sp UNION ALL SELECT conv_id, chunk, 2, 0, 'next', -10 FROM sp
  UNION ALL SELECT conv_id, e, 1, i * 2 + 1, 'token', tid FROM tg WHERE e < n_chunks UNION ALL SELECT conv_id, e, 1, i * 2, 'tag', -1 - speaker FROM tg WHERE tag),
ps AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY chunk, o, i) - 1 AS pos FROM it)
SELECT conv_id, kind, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum, CAST(sum(pos * label) AS BIGINT) AS check_sum FROM ps GROUP BY 1, 2""",
    "bad_utterances": with_(UTT, TOK, BAD) + "SELECT * FROM bad",
    "align_qc_report": with_(UTT, TOK, BAD) + """SELECT coalesce(reason, 'kept') AS reason, count(*) AS n_utts, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_tokens
FROM utt LEFT JOIN sm ON sm.utt_id = utt.utt_id LEFT JOIN bad ON bad.utt_id = utt.utt_id GROUP BY 1""",
    "token_rate": with_(UTT, TOK) + """, r AS (SELECT count(*) * 1000 / greatest(any_value(e) - any_value(s), 100) AS r FROM utt JOIN tok ON tok.utt_id = utt.utt_id GROUP BY utt.utt_id)
SELECT count(*) AS n, round(quantile_cont(r, 0.5), 6) AS p50, round(quantile_cont(r, 0.9), 6) AS p90, round(quantile_cont(r, 0.99), 6) AS p99,
  round(avg(CASE WHEN r > 12.5 THEN 1.0 ELSE 0.0 END), 6) AS over_1, round(avg(CASE WHEN r > 25 THEN 1.0 ELSE 0.0 END), 6) AS over_2, round(avg(CASE WHEN r > 37.5 THEN 1.0 ELSE 0.0 END), 6) AS over_3, round(avg(CASE WHEN r > 50 THEN 1.0 ELSE 0.0 END), 6) AS over_4 FROM r""",
}
