"""Readers, sinks and streams exercised over the data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.plans.base import CONV, UTT, conversations, utterances, with_
from colloquy.plans.events import EVENTS_CTE, HEAD, events
from colloquy.plans.interleave import TOK, sched, tokens
from colloquy.schema import SPEECH_LABELS
from colloquy.sources import readers
from colloquy.streaming import clock
from colloquy.tables import checkpoint_folder, checkpointed, millis, table


def _clock(ms: F.Column) -> F.Column:
    """Milliseconds as H:M:S,mmm."""
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def srt_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Utterances of each conversation and speaker written as subtitles and read again: conv_id, speaker, n, start and end sums, labelled, characters."""
    u = utterances(spark, d, "text", "label").where("s >= 0 and text is not null and trim(text) <> ''")
    block = F.concat(F.col("utt_id").cast("string"), F.lit("\n"), _clock(F.col("s")), F.lit(" --> "), _clock(F.col("e")), F.lit("\n"), F.when(F.col("label").isNotNull(), F.concat(F.lit("["), "label", F.lit("] "))).otherwise(""), F.col("text"))
    files = u.groupBy("conv_id", "speaker").agg(F.array_join(F.sort_array(F.collect_list(block)), "\n\n").alias("srt"))
    back = readers.parse_srt(files, "srt", "conv_id", "speaker")
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    return back.groupBy("conv_id", "speaker").agg(F.count("*").alias("n"), F.sum(ms("start_s")).alias("s"), F.sum(ms("end_s")).alias("e"), F.count(F.when(F.col("label") != "", 1)).alias("labelled"))


def jsonl_tolerant(spark: SparkSession, d: str) -> DataFrame:
    """Utterances as JSON lines, some of them damaged, read with the damaged ones left out: conv_id, n, ids."""
    u = utterances(spark, d)
    line = F.to_json(F.struct("utt_id", "conv_id", "speaker"))
    bad = F.when(F.col("utt_id") % 10 == 0, F.concat(line, F.lit("\x00"))).when(F.col("utt_id") % 10 == 1, F.substring(line, 1, 12)).when(F.col("utt_id") % 10 == 2, " ").otherwise(line)
    j = readers.parse_jsonl(u.select(bad.alias("value")), "value", "struct<utt_id:bigint,conv_id:string,speaker:int>")
    return j.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("utt_id").alias("ids"))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Manifest rows as JSON and back: id, source, duration in ms, number of meta keys."""
    c = spark.read.parquet(f"{d}/conversation.parquet").select("id", "source", "npz", "duration", "vad_source", "n_utts", "meta").dropDuplicates(["id"])
    j = readers.parse_jsonl(c.select(F.to_json(F.struct("*")).alias("value")), "value", "struct<id:string,source:string,npz:string,duration:double,vad_source:string,n_utts:int,meta:map<string,string>>")
    return j.select("id", "source", millis("duration").alias("ms"), F.size("meta").alias("n_meta"))


END = "2025-03-01 00:00:00"  # event time of the row that ends a stream


def _event_time(ms: F.Column) -> F.Column:
    return F.timestamp_millis(F.lit(clock.EPOCH_MS) + ms)


def _utterance_stream(spark: SparkSession, d: str) -> DataFrame:
    """Usable utterances as delivered, with an event time: the start of 2025 and the seconds within their conversation. Several files, one a batch."""
    u = table(spark, d, "utterance").select("utt_id", "conv_id", "speaker", millis("start_s").alias("s"), millis("end_s").alias("e"))
    u = u.where("speaker in (0, 1) and e > s and conv_id is not null")
    return clock.staged(u.withColumn("ts", _event_time(F.col("s"))).withColumn("ms", F.col("e") - F.col("s")), "ts", END)


def stream_tumbling_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Rows as delivered per ten seconds of conversation time; a window goes out once the watermark has passed it."""
    w = clock.drain(clock.chunk_activity(_utterance_stream(spark, d), "10 seconds", "1 minute")).where("ms is not null")
    return w.select(F.unix_millis("start").alias("start_ms"), "n", "ms")


def stream_chunk_clock(spark: SparkSession, d: str) -> DataFrame:
    """Utterances that start within each chunk of 80 ms."""
    w = clock.drain(clock.chunk_activity(_utterance_stream(spark, d), "80 milliseconds", "1 minute")).where("ms is not null")
    return w.select(F.unix_millis("start").alias("start_ms"), "n", "ms")


def stream_session_turns(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of a conversation in which utterances start less than five seconds apart."""
    s = clock.drain(clock.talk_sessions(_utterance_stream(spark, d), "5 seconds", "1 minute")).where("conv_id is not null")
    return s.select("conv_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "n")


def _emitted(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d).select("conv_id", "tid", "speaker", "end_ms", _event_time(F.col("end_ms")).alias("ts"))
    return clock.drain(clock.emit_tokens(clock.staged(t, "ts", END)))


def stream_emission_queue(spark: SparkSession, d: str) -> DataFrame:
    """Tokens through the streaming queue over several batches, the held ones flushed by a timer at the end; the same chunks as the batch schedule."""
    return _emitted(spark, d).select("conv_id", "tid", "e", "tag")


def stream_decode(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with the words that end in them as candidates, a score from their place, decoded two a chunk: tokens out per conversation, sum of chunk times token, forced chunks."""
    t = tokens(spark, d).select("conv_id", "speaker", F.floor(F.col("end_ms") / 80).alias("chunk"), "tid", (1000 - F.col("pos") * 7919 % 1000).cast("double").alias("score"))
    said = F.collect_list(F.struct(F.col("tid").alias("token"), "score"))
    c = t.groupBy("conv_id", "chunk").agg(said.alias("candidates")).withColumn("stop", F.lit(300.0)).withColumn("ts", _event_time(F.col("chunk") * 80))
    out = clock.drain(clock.decode_chunks(clock.staged(c, "ts", END), 2))
    return out.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.col("chunk") * F.col("token")).alias("check_sum"), F.max("forced").alias("forced"))


def stream_activity(spark: SparkSession, d: str) -> DataFrame:
    """Energy frames through the online detector over several batches: frames on, per series."""
    from colloquy.plans.signal import energy_db

    x = energy_db(spark, d).select(F.col("conv").cast("string").alias("conv_id"), "f", (F.col("db") - 30 * (F.floor(F.col("f") / 12) % 2)).alias("db"), _event_time(F.col("f") * 20).alias("ts"))
    out = clock.drain(clock.online_activity(clock.staged(x, "ts", END), -20, -31))
    return out.groupBy("conv_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("on"), 1)).alias("n_on"), F.sum(F.when(F.col("on"), F.col("f"))).alias("f_sum"))


def benchmark_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Utterances as nested rows in two snapshots, read as a corpus: conversations of the later one, each once, with utterances, active frames from labels and length."""
    u = utterances(spark, d, "text", "label")
    row = F.struct((F.col("s") / 1000).alias("start_s"), (F.col("e") / 1000).alias("end_s"), "text", "label")
    side = lambda k: F.collect_list(F.when(F.col("speaker") == k, row)).alias(f"speaker_{k + 1}_annotation_a")
    rows = checkpointed(u.groupBy(F.col("conv_id").alias("conversation_id")).agg(side(0), side(1)))
    folder = checkpoint_folder(spark, "benchmark")
    rows.limit(3).write.parquet(f"{folder}/2025-01/data")
    rows.union(rows).write.parquet(f"{folder}/2025-02/data")
    c = readers.read_corpus(spark, "turnbench-dev", folder)
    n = c.utterances.groupBy("conv_id").agg(F.count("*").alias("n"))
    active = c.segments.groupBy("conv_id").agg(F.sum(F.col("j") - F.col("i")).alias("n_active"))
    x = c.conversations.join(n, "conv_id").join(active, "conv_id", "left")
    return x.select("conv_id", F.round("duration", 3).alias("duration"), "n", F.coalesce("n_active", F.lit(0)).alias("n_active"))


def event_table_recomputed(spark: SparkSession, d: str) -> DataFrame:
    """Turn events written by corpus, one corpus written again in place, read back: corpus, kind, n."""
    from colloquy.sources.sinks import write_partitioned

    folder = checkpoint_folder(spark, "events")
    e = checkpointed(events(spark, d).withColumn("corpus", F.regexp_extract("conv_id", "^([a-z]+)", 1)))
    write_partitioned(e.where("kind <> 'HOLD'"), folder, "corpus")
    write_partitioned(e, folder, "corpus")
    write_partitioned(e.where("corpus = 'oto'"), folder, "corpus")
    return spark.read.parquet(folder).groupBy("corpus", "kind").agg(F.count("*").alias("n"))


def domain_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Whole seconds of conversation per domain."""
    return conversations(spark, d).groupBy("domain").agg(F.sum(F.floor(F.col("ms") / 1000)).alias("seconds"))


QUERIES = {
    "srt_round_trip": srt_round_trip, "jsonl_tolerant": jsonl_tolerant, "manifest_rows": manifest, "stream_tumbling_chunks": stream_tumbling_chunks, "stream_chunk_clock": stream_chunk_clock, "stream_decode": stream_decode, "stream_activity": stream_activity,
    "benchmark_round_trip": benchmark_round_trip, "event_table_recomputed": event_table_recomputed,
    "stream_session_turns": stream_session_turns, "stream_emission_queue": stream_emission_queue, "domain_seconds": domain_minutes,
}
RAW = "raw AS (SELECT utt_id, conv_id, CAST(round(start_s * 1000) AS BIGINT) AS s, CAST(round(end_s * 1000) AS BIGINT) AS e, 1735689600000 + CAST(round(start_s * 1000) AS BIGINT) AS ts FROM utterance WHERE speaker IN (0, 1) AND round(end_s * 1000) > round(start_s * 1000) AND conv_id IS NOT NULL)"
SQL = {
    "srt_round_trip": with_(UTT) + "SELECT conv_id, speaker, count(*) AS n, CAST(sum(s) AS BIGINT) AS s, CAST(sum(e) AS BIGINT) AS e, count(*) FILTER (label <> '') AS labelled FROM utt WHERE s >= 0 AND trim(text) <> '' GROUP BY 1, 2",
    "jsonl_tolerant": with_(UTT) + "SELECT conv_id, count(*) AS n, CAST(sum(utt_id) AS BIGINT) AS ids FROM utt WHERE utt_id % 10 > 2 GROUP BY 1",
    "manifest_rows": "SELECT id, source, CAST(round(duration * 1000) AS BIGINT) AS ms, CAST(cardinality(meta) AS INT) AS n_meta FROM (SELECT DISTINCT id, source, duration, meta FROM conversation)",
    "stream_tumbling_chunks": with_(RAW) + "SELECT CAST(floor(ts / 10000) AS BIGINT) * 10000 AS start_ms, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS ms FROM raw GROUP BY 1",
    "stream_chunk_clock": with_(RAW) + "SELECT CAST(floor(ts / 80) AS BIGINT) * 80 AS start_ms, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS ms FROM raw GROUP BY 1",
    "stream_decode": with_(UTT, TOK) + """, c AS (SELECT conv_id, end_ms // 80 AS chunk, tid, row_number() OVER (PARTITION BY conv_id, end_ms // 80 ORDER BY 1000 - pos * 7919 % 1000 DESC, tid) AS k FROM tok WHERE 1000 - pos * 7919 % 1000 > 300),
o AS (SELECT conv_id, count(*) FILTER (k <= 2) AS n, CAST(sum(chunk * tid) FILTER (k <= 2) AS BIGINT) AS check_sum, CAST(count(*) FILTER (k = 3) AS INT) AS forced FROM c GROUP BY 1) SELECT * FROM o""",
    "stream_activity": """WITH vec AS (SELECT vec_id // 50 AS conv, vec_id % 50 AS f, embedding AS vec FROM embeddings), db AS (SELECT conv, f, round(10 * log10(list_sum(list_transform(vec, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / len(vec) + 1e-10), 4) - 30 * ((f // 12) % 2) AS db FROM vec),
h AS (SELECT conv, f, coalesce(last_value(CASE WHEN db > -20 THEN 1 WHEN db <= -31 THEN 0 END IGNORE NULLS) OVER (PARTITION BY conv ORDER BY f ROWS UNBOUNDED PRECEDING), 0) AS o FROM db)
SELECT CAST(conv AS VARCHAR) AS conv_id, count(*) AS n, count(*) FILTER (o = 1) AS n_on, CAST(sum(f) FILTER (o = 1) AS BIGINT) AS f_sum FROM h GROUP BY 1""",
    "benchmark_round_trip": with_(UTT) + f""", fr AS (SELECT DISTINCT conv_id, speaker, unnest(generate_series(CAST(round_even(s / 20, 0) AS BIGINT), CAST(round_even(e / 20, 0) AS BIGINT) - 1)) AS f FROM utt WHERE label IN ({", ".join(f"'{x}'" for x in SPEECH_LABELS)}) AND round_even(e / 20, 0) > round_even(s / 20, 0))
SELECT 'tb-' || utt.conv_id AS conv_id, round(max(e) / 1000, 3) AS duration, count(*) AS n, coalesce((SELECT count(*) FROM fr WHERE fr.conv_id = utt.conv_id), 0) AS n_active FROM utt GROUP BY utt.conv_id""",
    "event_table_recomputed": HEAD(EVENTS_CTE) + "SELECT regexp_extract(conv_id, '^([a-z]+)', 1) AS corpus, kind, count(*) AS n FROM ev GROUP BY 1, 2",
    "stream_session_turns": with_(RAW) + """, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= 5000 THEN 0 ELSE 1 END AS cut FROM raw WINDOW w AS (PARTITION BY conv_id ORDER BY ts, utt_id)),
k AS (SELECT *, sum(cut) OVER (PARTITION BY conv_id ORDER BY ts, utt_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT conv_id, min(ts) AS start_ms, max(ts) + 5000 AS end_ms, count(*) AS n FROM k GROUP BY conv_id, run""",
    "stream_emission_queue": with_(UTT, TOK, sched("(4)")).replace("least(n_chunks, end_ms // 80 + 2) AS b", "end_ms // 80 + 2 AS b").replace("WHERE b < n_chunks", "") + "SELECT conv_id, tid, e, coalesce(lag(speaker) OVER (PARTITION BY conv_id ORDER BY i) <> speaker, true) AS tag FROM sc",
    "domain_seconds": with_(CONV) + "SELECT domain, CAST(sum(ms // 1000) AS BIGINT) AS seconds FROM conv GROUP BY 1",
}
