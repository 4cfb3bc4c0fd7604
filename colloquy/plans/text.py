"""Text, error rates and latency over the data set."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.text import clock_ms, normalize_ascii, normalize_text, word_edits, words
from colloquy.plans.base import UTT, utterances, with_
from colloquy.plans.interleave import TOK, sched, streams
from colloquy.operators.interleave import schedule
from colloquy.schema import CHUNK_MS
from colloquy.tables import table

ASCII = r"^[\x00-\x7F]*$"
HANGUL = r"\p{IsHangul}"


def normalize_texts(spark: SparkSession, d: str) -> DataFrame:
    """Normal form of the ASCII documents, which is what its SQL takes; normalize_all has every document."""
    t = table(spark, d, "documents").select("doc_id", "text").where(F.col("text").rlike(ASCII))
    return t.select("doc_id", normalize_ascii(F.col("text")).alias("norm"))


def normalize_all(spark: SparkSession, d: str) -> DataFrame:
    """Normal form of every document in its language."""
    return table(spark, d, "documents").select("doc_id", normalize_text(F.col("text"), F.col("lang")).alias("norm"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """An utterance and a line first delivered for the same conversation and start, however that is written, both with a text: conv_id, utt_id, raw_id, speaker, s, e, ref, hyp, start_time."""
    raw = table(spark, d, "raw_utterance").select("raw_id", "conv_id", F.col("text").alias("hyp"), "start_time").distinct().withColumn("s", clock_ms(F.col("start_time")))
    u = utterances(spark, d, "text").select("utt_id", "conv_id", "speaker", "s", "e", F.col("text").alias("ref"))
    return u.join(raw, ["conv_id", "s"]).where("ref is not null and hyp is not null").select("conv_id", "utt_id", "raw_id", "speaker", "s", "e", "ref", "hyp", "start_time")


def ref_hyp(spark: SparkSession, d: str) -> DataFrame:
    """All pairs whose utterance holds a word, in their normal form, words apart in every language: conv_id, utt_id, raw_id, speaker, s, e, ko, ref, hyp. The tables name no language; a pair is Korean (ko) if its utterance has Hangul in it."""
    x = pairs(spark, d).withColumn("ko", F.col("ref").rlike(HANGUL))
    norm = lambda c: normalize_text(F.col(c), F.lit(None).cast("string")).alias(c)
    return x.select("conv_id", "utt_id", "raw_id", "speaker", "s", "e", "ko", norm("ref"), norm("hyp")).where("ref <> ''")


def _by_speaker(x: DataFrame) -> DataFrame:
    x = x.select("speaker", F.levenshtein("ref", "hyp").alias("k"), F.length("ref").alias("n"))
    return x.groupBy("speaker").agg(F.count("*").alias("pairs"), F.sum("k").alias("edits"), F.sum("n").alias("chars"), F.round(F.sum("k") / F.sum("n"), 6).alias("cer"))


def cer(spark: SparkSession, d: str) -> DataFrame:
    """Character errors per speaker over the part of the pairs that its SQL takes: both texts ASCII, the start written as hours, minutes, seconds and three digits. cer_all has all pairs."""
    x = pairs(spark, d).where(F.col("start_time").rlike("^[0-9]{2}:[0-9]{2}:[0-9]{2}[.,][0-9]{3}$") & F.col("ref").rlike(ASCII) & F.col("hyp").rlike(ASCII))
    return _by_speaker(x.select("speaker", normalize_ascii(F.col("ref")).alias("ref"), normalize_ascii(F.col("hyp")).alias("hyp")).where("ref <> ''"))


def cer_all(spark: SparkSession, d: str) -> DataFrame:
    """Character errors per speaker, summed over all pairs; Korean without its spaces."""
    bare = lambda c: F.when(F.col("ko"), F.replace(F.col(c), F.lit(" "))).otherwise(F.col(c)).alias(c)
    return _by_speaker(ref_hyp(spark, d).select("speaker", bare("ref"), bare("hyp")))


def wer(spark: SparkSession, d: str) -> DataFrame:
    """Word errors of each pair, words as they are spaced."""
    x = ref_hyp(spark, d).select("utt_id", "raw_id", words(F.col("ref")).alias("r"), words(F.col("hyp")).alias("h"))
    return x.select("utt_id", "raw_id", word_edits(F.col("r"), F.col("h")).alias("edits"), F.size("r").alias("n_words"))


def _joined(x: DataFrame, *by: str) -> DataFrame:
    """References and hypotheses of each group, one after the other in order of time, and the characters between them."""
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "utt_id", "raw_id", F.col(c).alias("t")))), lambda r: r["t"]), " ").alias(c)
    return x.groupBy(*by).agg(text("ref"), text("hyp")).withColumns({"k": F.levenshtein("ref", "hyp"), "n": F.length("ref")})


def pooled_error(spark: SparkSession, d: str) -> DataFrame:
    """Character errors of each minute of a conversation with both speakers' lines in one order of time, and kept apart; what the two differ by is due to who spoke."""
    x = ref_hyp(spark, d).withColumn("minute", F.floor(F.col("s") / 60_000))
    rate = lambda y, name: y.groupBy("ko").agg(F.sum("n").alias("chars"), F.round(F.sum("k") / F.sum("n"), 6).alias(name))
    apart, pooled = rate(_joined(x, "ko", "conv_id", "minute", "speaker"), "err"), rate(_joined(x, "ko", "conv_id", "minute"), "err_pooled").drop("chars")
    return apart.join(pooled, "ko")


def baseline_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors by corpus of lines as delivered and of lines without what stands in brackets: character errors for Korean, word errors else."""
    bare = F.regexp_replace("hyp", r"\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|<[^>]*>", " ")
    norm = lambda c: normalize_text(c, F.lit(None).cast("string"))
    both = pairs(spark, d).withColumn("h", F.explode(F.array(F.struct(F.lit("as delivered").alias("system"), F.col("hyp").alias("t")), F.struct(F.lit("without brackets").alias("system"), bare.alias("t")))))
    x = both.select(F.regexp_extract("conv_id", "^([a-z]+)", 1).alias("corpus"), "h.system", F.col("ref").rlike(HANGUL).alias("ko"), norm(F.col("ref")).alias("ref"), norm(F.col("h.t")).alias("hyp")).where("ref <> ''")
    plain = lambda c: F.replace(F.col(c), F.lit(" "))
    r, h = words(F.col("ref")), words(F.col("hyp"))
    k, n = F.when(F.col("ko"), F.levenshtein(plain("ref"), plain("hyp"))).otherwise(word_edits(r, h)), F.when(F.col("ko"), F.length(plain("ref"))).otherwise(F.size(r))
    return x.select("corpus", "system", "ko", k.alias("k"), n.alias("n")).groupBy("corpus", "system", "ko").agg(F.count("*").alias("pairs"), F.sum("k").alias("edits"), F.sum("n").alias("units"), F.round(F.sum("k") / F.sum("n"), 6).alias("error"))


def emission_latency(spark: SparkSession, d: str) -> DataFrame:
    """Delay of emitted tokens behind their end: quantiles in ms, shares before the end and forced past their own chunk."""
    t, n = streams(spark, d)
    x = schedule(t, n, 4, 2).where("e < n_chunks").select(((F.col("e") + 1) * CHUNK_MS - F.col("end_ms")).alias("v"), (F.col("e") > F.col("b")).alias("late"))
    x = x.groupBy("v", "late").agg(F.count("*").alias("k"))  # a row per value, so that the quantiles see few
    q = [F.round(F.percentile("v", F.lit(p), F.col("k")), 6).alias(f"p{int(100 * p)}") for p in (0.5, 0.9, 0.99)]
    share = lambda c: F.round(F.sum(F.when(c, F.col("k")).otherwise(0)) / F.sum("k"), 6)
    return x.agg(F.sum("k").alias("n"), *q, share(F.col("v") < 0).alias("before_end"), share(F.col("late")).alias("forced"))


def _latencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for utt, raw, ref, hyp, s, e in b[["utt_id", "raw_id", "ref", "hyp", "s", "e"]].itertuples(index=False):
            r, h = ref.split(), hyp.split()
            for block in SequenceMatcher(None, h, r, autojunk=False).get_matching_blocks():
                for k in range(block.size):
                    end, heard = s + (block.b + k + 1) * (e - s) // len(r), s + (block.a + k + 1) * (e - s) // len(h)
                    rows.append((utt, raw, block.b + k, (heard // CHUNK_MS + 1) * CHUNK_MS - end))
        yield pd.DataFrame(rows, columns=["utt_id", "raw_id", "pos", "latency_ms"])


def token_latency(spark: SparkSession, d: str) -> DataFrame:
    """Delay of the words of a line that match its utterance's, by longest matching blocks."""
    return ref_hyp(spark, d).where("hyp <> ''").mapInPandas(_latencies, "utt_id bigint, raw_id bigint, pos int, latency_ms bigint")


NORM = r"trim(regexp_replace(regexp_replace(lower(regexp_replace({0}, '<[^>]{{1,20}}>', '', 'g')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
PAIRS = r"""rw AS (SELECT raw_id, conv_id, text AS hyp, ((CAST(start_time[1:2] AS BIGINT) * 60 + CAST(start_time[4:5] AS BIGINT)) * 60 + CAST(start_time[7:8] AS BIGINT)) * 1000 + CAST(start_time[10:12] AS BIGINT) AS s
  FROM (SELECT DISTINCT raw_id, conv_id, text, start_time FROM raw_utterance WHERE regexp_full_match(start_time, '[0-9]{2}:[0-9]{2}:[0-9]{2}[.,][0-9]{3}'))),
pr AS (SELECT * FROM (SELECT utt_id, raw_id, speaker, """ + NORM.format("utt.text") + " AS ref, " + NORM.format("rw.hyp") + r""" AS hyp FROM utt JOIN rw ON rw.conv_id = utt.conv_id AND rw.s = utt.s
  WHERE regexp_full_match(utt.text, '[\x00-\x7F]*') AND regexp_full_match(rw.hyp, '[\x00-\x7F]*')) WHERE ref <> '')"""
QUERIES = {"normalize_text": normalize_texts, "normalize_all": normalize_all, "cer": cer, "cer_all": cer_all, "wer": wer, "pooled_error": pooled_error, "baseline_errors": baseline_errors, "emission_latency": emission_latency, "token_latency": token_latency}
SQL = {
    "normalize_text": "SELECT doc_id, " + NORM.format("text") + r" AS norm FROM documents WHERE regexp_full_match(text, '[\x00-\x7F\n]*', 's')",
    "cer": with_(UTT, PAIRS) + "SELECT speaker, count(*) AS pairs, CAST(sum(levenshtein(ref, hyp)) AS BIGINT) AS edits, CAST(sum(length(ref)) AS BIGINT) AS chars, round(sum(levenshtein(ref, hyp)) / sum(length(ref)), 6) AS cer FROM pr GROUP BY 1",
    "emission_latency": with_(UTT, TOK, sched("(4)")) + """SELECT count(*) AS n, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.99), 6) AS p99,
  round(avg(CASE WHEN v < 0 THEN 1.0 ELSE 0.0 END), 6) AS before_end, round(avg(CASE WHEN e > b THEN 1.0 ELSE 0.0 END), 6) AS forced FROM (SELECT *, CAST((e + 1) * 80 - end_ms AS DOUBLE) AS v FROM sc WHERE e < n_chunks)""",
}
