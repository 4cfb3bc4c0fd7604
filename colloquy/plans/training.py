"""Windows, examples and token streams for training, over the data set.

Feature frames are the embeddings: fifty frames at 5 Hz for the conversation whose number is the place of the fifty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import interleave as il
from colloquy.operators import training as ops
from colloquy.operators import windows as win
from colloquy.operators.events import quality_flags, turn_events
from colloquy.plans import events as ev
from colloquy.plans import interleave as pi
from colloquy.plans.base import CONV, LEN, SEG, UTT, conversations, lengths, timeline, utterances, with_
from colloquy.plans.frames import FR, POOL
from colloquy.plans.signal import VEC, vectors
from colloquy.plans.windows import HOP, WIN, WINDOW
from colloquy.schema import CHUNK_MS, NONSPEECH_LABELS, SPEECH_LABELS
from colloquy.functions.text import SPACES_SQL, stripped
from colloquy.tables import checkpointed, table

HZ, PROBE_WINDOW, PROBE_HOP = 5, 200, 100  # of the features; windows of 4 s every 2 s, in 50 Hz frames
SPAN_MS, CHUNKS = 30_000, 375  # interleaved windows of 30 s


def number(c: str = "conv_id") -> Column:
    """The number at the end of an id."""
    return F.regexp_extract(c, r"([0-9]+)$", 1).try_cast("bigint")


def flagged(seg: DataFrame, length: DataFrame) -> DataFrame:
    """Conversations with a quality flag."""
    return quality_flags(seg, length, turn_events(seg, length)).select("conv_id").distinct()


def _unflagged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    seg, length = timeline(spark, d)
    return seg, checkpointed(length.join(flagged(seg, length), "conv_id", "left_anti"))


def training_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 20 s every 10 s of the conversations without a flag."""
    return win.sliding_windows(_unflagged(spark, d)[1], WINDOW, HOP)


def window_batch(spark: SparkSession, d: str) -> DataFrame:
    """Those windows as examples at 12.5 Hz: frames active of each speaker, frames with a label, label and onset-bin sums, censored frames."""
    seg, length = _unflagged(spark, d)
    return ops.example_totals(ops.materialized(ops.windowed_segments(win.sliding_windows(length, WINDOW, HOP), seg, WINDOW, HOP), ["conv_id", "win"], WINDOW, 12.5), ["conv_id", "win"])


def _cached(spark: SparkSession, d: str, part: str = "true") -> DataFrame:
    """Feature index: number, frames."""
    return vectors(spark, d).where(part).groupBy(F.col("conv").alias("number")).agg((F.max("f") + 1).alias("frames"))


def feature_index(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, frames, dim and rate of the cached features of each conversation that has some."""
    dim = vectors(spark, d).select(F.size("vec").alias("dim")).limit(1)
    named = conversations(spark, d).select("conv_id", number().alias("number")).distinct()
    return named.join(_cached(spark, d), "number").join(F.broadcast(dim), F.lit(True)).select("conv_id", "frames", "dim", F.lit(HZ).alias("hz"))  # dim: one row


def _probe_windows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    seg, length = _unflagged(spark, d)
    indexed = length.withColumn("number", number()).join(_cached(spark, d), "number")
    return seg, win.sliding_windows(indexed.select("conv_id", "t"), PROBE_WINDOW, PROBE_HOP)


def feature_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 4 s of the conversations with features and without a flag, in a seeded order, 400 at most."""
    w = _probe_windows(spark, d)[1]
    return ops.capped(w, [ops.shuffled(number() * 131 + F.col("win")), F.col("conv_id"), F.col("win")], 400)


def paired_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of the conversations that two caches have; the second holds what has a label above 2 in it."""
    both = _cached(spark, d).select("number").join(_cached(spark, d, "label > 2").select("number"), "number")
    length = timeline(spark, d)[1].withColumn("number", number()).join(both, "number").select("conv_id", "t")
    return win.sliding_windows(length, PROBE_WINDOW, PROBE_HOP)


def probe_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 4 s with features at 5 Hz: frames, sum of the first component, frames active, labels and their sum."""
    seg, w = _probe_windows(spark, d)
    spans = w.select(F.concat("conv_id", F.lit("#"), "win").alias("key"), "conv_id", "win", "start", number().alias("conv"), F.bround(F.col("start") * HZ / 50).cast("bigint").alias("a"), F.bround((F.col("start") + PROBE_WINDOW) * HZ / 50).cast("bigint").alias("b"))
    sliced = ops.feature_slices(spans, vectors(spark, d), "key", "conv").where(F.size("feats") > 0)
    x = ops.probe_examples(ops.windowed_segments(sliced, seg, PROBE_WINDOW, PROBE_HOP), ["conv_id", "win"], PROBE_WINDOW, HZ)
    labels = F.filter("label", lambda v: v >= 0)
    total = lambda c, zero, f: F.aggregate(c, zero, lambda a, v: a + f(v))
    first = F.round(total(F.col("feats"), F.lit(0.0), lambda v: F.element_at(v, 1).cast("double")), 4)
    return x.select("conv_id", "win", F.size("feats").alias("n"), first.alias("first"), total(F.col("vad"), F.lit(0), lambda v: v[0].cast("int") + v[1].cast("int")).alias("n_active"), F.size(labels).alias("n_labels"), total(labels, F.lit(0), lambda v: v).alias("label_sum"))


def val_carve_out(spark: SparkSession, d: str) -> DataFrame:
    return ops.carve_out(conversations(spark, d), "conv_id", number(), 0.1, 2000)


def manifest_subset(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 conversations in order of id that have features and no flag."""
    length = _unflagged(spark, d)[1].withColumn("number", number())
    return length.join(_cached(spark, d), "number", "left_semi").select("conv_id", "t").orderBy("conv_id").limit(25)


def spoken(spark: SparkSession, d: str, swap: bool, least: int, most: int | None) -> DataFrame:
    """Utterances with words and a fitting length, channels exchanged where the manifest says so."""
    u = utterances(spark, d, "text", "label").where((F.col("e") - F.col("s") >= least) & (stripped(F.col("text")) != ""))
    u = u if most is None else u.where(F.col("e") - F.col("s") <= most)
    if not swap:
        return u
    c = table(spark, d, "conversation").where("id is not null").groupBy(F.col("id").alias("conv_id")).agg(F.max(F.col("meta")["speaker_channel_swapped"]).alias("swapped"))
    flip = F.coalesce(F.col("swapped") == "true", F.lit(False))
    return u.join(c, "conv_id", "left").withColumn("speaker", F.when(flip, 1 - F.col("speaker")).otherwise(F.col("speaker"))).drop("swapped")


def utterance_iterator(spark: SparkSession, d: str) -> DataFrame:
    """Utterances of 0.3 to 20 s with words, channels exchanged where marked."""
    return spoken(spark, d, True, 300, 20_000).select("utt_id", "conv_id", "speaker", F.length(stripped(F.col("text"))).alias("n_chars"))


def alignment_utterances(spark: SparkSession, d: str) -> DataFrame:
    """Utterances for an aligner: at least 0.3 s, no upper limit, channels as they are."""
    return spoken(spark, d, False, 300, None).select("utt_id", "conv_id", "speaker", F.length(stripped(F.col("text"))).alias("n_chars"))


def label_categories(spark: SparkSession, d: str) -> DataFrame:
    """Utterances by category of label."""
    u = utterances(spark, d, "label")
    kind = F.when(F.col("label").isin(*SPEECH_LABELS), "speech").when(F.col("label").isin(*NONSPEECH_LABELS), "nonspeech").otherwise("other")
    return u.groupBy("conv_id", kind.alias("category")).agg(F.count("*").alias("n"))


def label_vad(spark: SparkSession, d: str) -> DataFrame:
    """Voice activity from labels: merged frames of the utterances whose label is a kind of speech."""
    from colloquy.operators.coverage import periods_and_gaps

    u = utterances(spark, d, "label").where(F.col("label").isin(*SPEECH_LABELS)).select("conv_id", "speaker", F.bround(F.col("s") / 20).cast("bigint").alias("i"), F.bround(F.col("e") / 20).cast("bigint").alias("j"))
    return periods_and_gaps(u, ["conv_id", "speaker"], "i", "j").where("kind = 'period'").drop("kind")


def frame_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Frames of each conversation by who is active: nobody, a, b, both."""
    length = timeline(spark, d)[1]
    o = ev.overlap_stats(spark, d)
    z = lambda c: F.coalesce(c, F.lit(0))
    return length.join(o, "conv_id", "left").select("conv_id", (F.col("t") - z("n_either")).alias("n_none"), (z("n_a") - z("n_both")).alias("n_only_a"), (z("n_b") - z("n_both")).alias("n_only_b"), z("n_both").alias("n_both"))


def utterance_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of each utterance at 13 Hz: frames taken, frames out, sum of the first component."""
    u = spoken(spark, d, True, 300, 20_000).select("utt_id", number().alias("conv"), F.floor(F.col("s") * HZ / 1000).alias("a"), F.ceil(F.col("e") * HZ / 1000).alias("b0"))
    spans = u.select("utt_id", "conv", "a", F.greatest(F.col("a") + 2, F.col("b0")).alias("b"))
    x = ops.feature_slices(spans, vectors(spark, d), "utt_id", "conv").where(F.size("feats") > 0).withColumn("out", ops.nearest_resampled(F.col("feats"), HZ, 13))
    return x.select("utt_id", F.size("feats").alias("n"), F.size("out").alias("n_out"), F.round(F.aggregate("out", F.lit(0.0), lambda s, v: s + F.element_at(v, 1).cast("double")), 4).alias("first"))


def _kept_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the utterances that quality control doesn't reject."""
    t = checkpointed(pi.tokens(spark, d))
    bad = il.bad_utterances(utterances(spark, d), t)
    return t.join(bad.select("utt_id"), "utt_id", "left_anti")


def aligned_stats(spark: SparkSession, d: str) -> DataFrame:
    """Emission of the tokens that are kept, over the length of all utterances."""
    n = utterances(spark, d).groupBy("conv_id").agg(F.max("e").alias("ms"))
    return il.emission_stats(il.schedule(_kept_tokens(spark, d), n, 4, 2), n).drop("m")


def tokens_in_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that end within each window of 20 s, and the sum of their times in it."""
    t = ops.in_windows(pi.tokens(spark, d), F.col("end_ms"), F.col("end_ms") + 1, WINDOW * 20, HOP * 20)
    held = t.groupBy("conv_id", "win").agg(F.count("*").alias("n"), F.sum("end_ms").alias("ms"))  # a row a window before any join
    whole = lengths(spark, d).where(F.col("t") >= WINDOW).select("conv_id", F.floor((F.col("t") - WINDOW) / HOP).alias("last"))
    start_ms = F.col("win").cast("bigint") * (HOP * 20)
    fit = held.hint("merge").join(whole, "conv_id").where("win <= last")
    return fit.groupBy("conv_id", "win").agg(F.sum("n").alias("n"), F.sum(F.col("ms") - F.col("n") * start_ms).alias("ms"))


def interleaved_starts(spark: SparkSession, d: str) -> DataFrame:
    """Silent starts of windows of 30 s that no rejected utterance touches, three a conversation in a seeded order, 300 in all, each with its delay."""
    u = checkpointed(utterances(spark, d))
    bad = il.bad_utterances(u, pi.tokens(spark, d)).join(u, "utt_id").select("conv_id", "s", "e")
    starts = win.silent_starts(u.select("conv_id", "s", "e"), SPAN_MS, 1000, 500).withColumn("win", (F.col("start") / 1000).cast("int"))
    kept = win.drop_touched(starts, bad, SPAN_MS, 1000)
    some = win.sample_per_group(kept.withColumn("k", F.col("start") / 1000), "conv_id", "k", 3).drop("k")
    order = ops.shuffled(number() * 131 + F.col("win"))
    delay = F.element_at(F.array(*map(F.lit, ops.DELAYS)), (F.pmod(number() * 31 + F.col("win") * 17, F.lit(len(ops.DELAYS))) + 1).cast("int"))
    return ops.capped(some, [order, F.col("conv_id"), F.col("win")], 300).select("conv_id", "start", delay.alias("delay"))


def interleaved_windows(spark: SparkSession, d: str) -> DataFrame:
    """Those windows as sequences: prefix, an audio slot for each speaker and chunk, tokens by schedule: items, labels that count, sum of position times label."""
    w = checkpointed(interleaved_starts(spark, d).withColumn("key", F.concat("conv_id", F.lit("#"), "start")))
    u = _kept_tokens(spark, d).select("conv_id", "speaker", "tid", "end_ms")
    cell = F.floor(F.col("end_ms") / SPAN_MS)
    reach = w.select("key", "conv_id", "start", "delay", F.explode(F.sequence(F.floor(F.col("start") / SPAN_MS), F.floor((F.col("start") + SPAN_MS - 1) / SPAN_MS))).alias("c"))
    inside = reach.join(u.withColumn("c", cell), ["conv_id", "c"]).where(f"end_ms >= start and end_ms < start + {SPAN_MS}")
    t = inside.select("key", "speaker", "tid", (F.col("end_ms") - F.col("start") + (F.col("delay") - 2) * CHUNK_MS).alias("end_ms"))  # a later delay is as good as a later end
    length = w.select("key", F.lit(SPAN_MS).alias("ms"))
    seq = il.model_sequence(il.schedule(t, length, 4, 2, key="key"), length, key="key", slots=2)
    prefix = F.array(F.lit(-1), F.lit(-2), -10 - F.col("delay"))
    x = ops.with_prefix(seq, w, "key", prefix)
    return x.groupBy("key").agg(F.count("*").alias("n"), F.count(F.when(F.col("label") != ops.IGNORED, 1)).alias("n_labels"), F.sum(F.when(F.col("label") != ops.IGNORED, F.col("pos") * F.col("label"))).alias("label_sum"))


def special_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Control tokens and their ids, behind the vocabulary."""
    return spark.createDataFrame([(name, 50_257 + i) for i, name in enumerate(ops.SPECIALS)], "name string, id int")


def sequence_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per conversation: items of the model sequence, and the share of signs for the next chunk among labels that count."""
    t, n = pi.streams(spark, d)
    seq = il.model_sequence(il.schedule(t, n, 4, 2), n)
    label = F.col("label") != ops.IGNORED
    return seq.groupBy("conv_id").agg(F.count("*").alias("n"), F.round(F.count(F.when(F.col("kind") == "next", 1)) / F.count(F.when(label, 1)), 6).alias("next_share"))


def collated(spark: SparkSession, d: str) -> DataFrame:
    """Token lists of the utterances of a conversation, padded to its longest: utt_id, size, number of padding signs."""
    t = pi.tokens(spark, d).groupBy("conv_id", "utt_id").agg(F.sort_array(F.collect_list("tid")).alias("ids"))
    x = win.pad_batches(t, "conv_id", "ids", ops.IGNORED)
    return x.select("utt_id", F.size("ids").alias("size"), F.size(F.filter("ids", lambda v: v == ops.IGNORED)).alias("n_pad"))


def budget_report(spark: SparkSession, d: str) -> DataFrame:
    """Overflow a token, largest backlog and share of silent chunks for one to four tokens a chunk."""
    t, n = pi.streams(spark, d)
    s = checkpointed(il.schedule(t.withColumn("m", F.explode(F.array(*(F.lit(i) for i in range(1, 5))))), n, None, 2))
    a = il.emission_stats(s, n).groupBy("m").agg(F.round(F.sum("overflow_tokens") / F.sum("tokens"), 6).alias("overflow"), F.max("max_backlog").alias("max_backlog"))
    h = il.chunk_histogram(s, n).groupBy("m").agg(F.round(F.sum(F.when(F.col("n_tokens") == 0, F.col("n"))) / F.sum("n"), 6).alias("silent"))
    return a.join(h, "m")


def qc_before_after(spark: SparkSession, d: str) -> DataFrame:
    """Overflow and largest backlog with and without the rejected utterances."""
    n = utterances(spark, d).groupBy("conv_id").agg(F.max("e").alias("ms"))
    rows = [il.emission_stats(il.schedule(t, n, 4, 2), n).agg(F.sum("tokens").alias("tokens"), F.sum("overflow_tokens").alias("overflow_tokens"), F.max("max_backlog").alias("max_backlog")).withColumn("qc", F.lit(qc)) for qc, t in ((False, pi.tokens(spark, d)), (True, _kept_tokens(spark, d)))]
    return rows[0].unionByName(rows[1])


def worst_utterances(spark: SparkSession, d: str) -> DataFrame:
    """The three rejected utterances with the most tokens."""
    t = checkpointed(pi.tokens(spark, d))
    n = t.groupBy("utt_id").agg(F.count("*").alias("n"))
    return il.bad_utterances(utterances(spark, d), t).join(n, "utt_id").orderBy(F.desc("n"), "utt_id").limit(3).select("utt_id", "reason", "n")


_body = ev.SQL["quality_flags"].removeprefix(ev.HEAD(ev.EVENTS_CTE)).lstrip(", ")
_r, _select = _body.split("\nSELECT conv_id, 'one", 1)
FLAGS = f"{_r},\nfl AS (SELECT conv_id, 'one{_select}),\nok AS (SELECT * FROM len WHERE conv_id NOT IN (SELECT conv_id FROM fl))"
UNFLAGGED = ev.HEAD(ev.EVENTS_CTE, FLAGS)
NUM = "CAST(regexp_extract({0}, '([0-9]+)$', 1) AS BIGINT)"
CACHED = VEC + ",\nix AS (SELECT conv AS number, max(f) + 1 AS frames FROM vec GROUP BY 1)"
PW = f"pw AS (SELECT conv_id, CAST(k AS INT) AS win, CAST(k * {PROBE_HOP} AS BIGINT) AS start FROM (SELECT conv_id, unnest(generate_series(0, (t - {PROBE_WINDOW}) // {PROBE_HOP})) AS k FROM ok JOIN ix ON ix.number = {NUM.format('conv_id')} WHERE t >= {PROBE_WINDOW}))"
TW = f"tw AS (SELECT conv_id, CAST(k AS INT) AS win, CAST(k * {HOP} AS BIGINT) AS start FROM (SELECT conv_id, unnest(generate_series(0, (t - {WINDOW}) // {HOP})) AS k FROM ok WHERE t >= {WINDOW}))"


def _label_sql(source: str, keys: str, n: int, bins: tuple[int, ...]) -> str:
    edges, at = [], 1
    for width in bins:
        edges.append((at, at + width - 1, width))
        at += width
    bits = " + ".join(f"(CASE WHEN 2 * sum({c}) OVER (PARTITION BY {keys} ORDER BY f ROWS BETWEEN {lo} FOLLOWING AND {hi} FOLLOWING) >= {w} THEN {1 << (4 * s + k)} ELSE 0 END)" for s, c in enumerate("ab") for k, (lo, hi, w) in enumerate(edges))
    return f"SELECT *, {bits} AS label FROM {source}"


LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)
STRIPPED = rf"regexp_replace(text, '^{SPACES_SQL}+|{SPACES_SQL}+$', '', 'g')"
SPOKEN = f"""sw AS (SELECT id AS conv_id, max(meta['speaker_channel_swapped']) AS swapped FROM conversation WHERE id IS NOT NULL GROUP BY 1),
sk AS (SELECT utt_id, utt.conv_id, s, e, CASE WHEN coalesce(swapped = 'true', false) THEN 1 - speaker ELSE speaker END AS speaker, text FROM utt LEFT JOIN sw ON sw.conv_id = utt.conv_id WHERE e - s BETWEEN 300 AND 20000 AND {STRIPPED} <> '')"""
KEPT = "kt AS (SELECT tok.* FROM tok WHERE utt_id NOT IN (SELECT utt_id FROM bad))"
QUERIES = {
    "training_windows": training_windows, "window_batch": window_batch, "feature_index": feature_index, "feature_windows": feature_windows, "paired_windows": paired_windows, "probe_windows": probe_windows,
    "val_carve_out": val_carve_out, "manifest_subset": manifest_subset, "utterance_iterator": utterance_iterator, "alignment_utterances": alignment_utterances, "label_categories": label_categories, "label_vad": label_vad,
    "frame_matrix": frame_matrix, "utterance_features": utterance_features, "aligned_stats": aligned_stats, "tokens_in_windows": tokens_in_windows, "interleaved_starts": interleaved_starts, "interleaved_windows": interleaved_windows,
    "special_tokens": special_tokens, "sequence_shares": sequence_shares, "collated": collated, "budget_report": budget_report, "qc_before_after": qc_before_after, "worst_utterances": worst_utterances,
}
SQL = {
    "training_windows": ev.HEAD(ev.EVENTS_CTE, FLAGS, TW) + "SELECT * FROM tw",
    "window_batch": ev.HEAD(ev.EVENTS_CTE, FLAGS, TW, FR) + """, sp AS (SELECT conv_id, win, start, unnest(generate_series(0, 249)) AS f FROM tw),
ch AS (SELECT DISTINCT conv_id, speaker, f // 4 AS chunk FROM act),
wx AS (SELECT sp.*, CASE WHEN ca.chunk IS NULL THEN 0 ELSE 1 END AS a, CASE WHEN cb.chunk IS NULL THEN 0 ELSE 1 END AS b FROM sp LEFT JOIN ch ca ON ca.conv_id = sp.conv_id AND ca.chunk = sp.start // 4 + sp.f AND ca.speaker = 0 LEFT JOIN ch cb ON cb.conv_id = sp.conv_id AND cb.chunk = sp.start // 4 + sp.f AND cb.speaker = 1),
wy AS (""" + _label_sql("wx", "conv_id, win", 250, (2, 5, 8, 10)) + """),
wv AS (SELECT conv_id, win, f, 0 AS speaker, a AS v FROM wx UNION ALL SELECT conv_id, win, f, 1, b FROM wx),
wo AS (SELECT *, CASE WHEN v = 1 AND coalesce(sum(v) OVER (PARTITION BY conv_id, win, speaker ORDER BY f ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) = 0 THEN f END AS onset FROM wv),
wq AS (SELECT *, min(onset) OVER (PARTITION BY conv_id, win, speaker ORDER BY f ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - f AS tau FROM wo),
bn AS (SELECT conv_id, win, CAST(sum(CASE WHEN tau IS NULL OR tau > 32 THEN 5 ELSE (tau >= 2)::INT + (tau >= 4)::INT + (tau >= 8)::INT + (tau >= 16)::INT + (tau >= 32)::INT END) AS BIGINT) AS bin_sum, count(*) FILTER (tau IS NULL OR tau > 32) AS n_censored FROM wq GROUP BY 1, 2)
SELECT wy.conv_id, wy.win, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b, count(*) FILTER (f < 225) AS n_labels, CAST(sum(label * (f + 1)) FILTER (f < 225) AS BIGINT) AS label_sum, any_value(bin_sum) AS bin_sum, any_value(n_censored) AS n_censored
FROM wy JOIN bn ON bn.conv_id = wy.conv_id AND bn.win = wy.win GROUP BY 1, 2""",
    "feature_index": with_(CONV, CACHED) + f"SELECT DISTINCT conv_id, frames, (SELECT len(vec) FROM vec LIMIT 1)::INT AS dim, {HZ} AS hz FROM conv JOIN ix ON ix.number = {NUM.format('conv_id')}",
    "feature_windows": ev.HEAD(ev.EVENTS_CTE, FLAGS, CACHED, PW) + f"SELECT * FROM pw ORDER BY (({NUM.format('conv_id')} * 131 + win) * 7919) % 100003, conv_id, win LIMIT 400",
    "paired_windows": with_(CONV, SEG, LEN, CACHED, PW.replace("FROM ok JOIN ix", "FROM len JOIN ix").replace("WHERE t >=", "WHERE ix.number IN (SELECT conv FROM vec WHERE label > 2) AND t >=")) + "SELECT * FROM pw",
    "probe_windows": ev.HEAD(ev.EVENTS_CTE, FLAGS, CACHED, PW, FR) + f""", fs AS (SELECT pw.*, vec.f - CAST(round_even(start * {HZ} / 50, 0) AS BIGINT) AS f, vec.vec[1] AS v FROM pw JOIN vec ON vec.conv = {NUM.format('pw.conv_id')} AND vec.f >= round_even(start * {HZ} / 50, 0) AND vec.f < round_even((start + {PROBE_WINDOW}) * {HZ} / 50, 0)),
wx AS (SELECT conv_id, win, f, v, coalesce((SELECT 1 FROM act WHERE act.conv_id = fs.conv_id AND act.speaker = 0 AND act.f >= start + fs.f * 10 AND act.f < start + fs.f * 10 + 10 LIMIT 1), 0) AS a,
  coalesce((SELECT 1 FROM act WHERE act.conv_id = fs.conv_id AND act.speaker = 1 AND act.f >= start + fs.f * 10 AND act.f < start + fs.f * 10 + 10 LIMIT 1), 0) AS b, count(*) OVER (PARTITION BY conv_id, win) AS n FROM fs),
wy AS (""" + _label_sql("wx", "conv_id, win", 20, (1, 2, 3, 4)) + """)
SELECT conv_id, win, CAST(count(*) AS INT) AS n, round(sum(CAST(v AS DOUBLE)), 4) AS first, CAST(sum(a + b) AS INT) AS n_active, CAST(count(*) FILTER (f < n - 10) AS INT) AS n_labels, CAST(coalesce(sum(label) FILTER (f < n - 10), 0) AS INT) AS label_sum FROM wy GROUP BY 1, 2""",
    "val_carve_out": with_(CONV) + f""", k AS (SELECT conv_id, row_number() OVER (ORDER BY ({NUM.format('conv_id')} * 7919) % 100003, conv_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conv))
SELECT conv_id, CASE WHEN r <= least(2000, greatest(1, CAST(floor(n * 0.1) AS BIGINT))) THEN 'val' ELSE 'train' END AS split FROM k""",
    "manifest_subset": ev.HEAD(ev.EVENTS_CTE, FLAGS, CACHED) + f"SELECT conv_id, t FROM ok WHERE {NUM.format('conv_id')} IN (SELECT number FROM ix) ORDER BY conv_id LIMIT 25",
    "utterance_iterator": with_(UTT, SPOKEN) + f"SELECT utt_id, conv_id, speaker, CAST(length({STRIPPED}) AS INT) AS n_chars FROM sk",
    "alignment_utterances": with_(UTT) + f"SELECT utt_id, conv_id, speaker, CAST(length({STRIPPED}) AS INT) AS n_chars FROM utt WHERE e - s >= 300 AND {STRIPPED} <> ''",
    "label_categories": with_(UTT) + f"SELECT conv_id, CASE WHEN label IN ({LIST(SPEECH_LABELS)}) THEN 'speech' WHEN label IN ({LIST(NONSPEECH_LABELS)}) THEN 'nonspeech' ELSE 'other' END AS category, count(*) AS n FROM utt GROUP BY 1, 2",
    "label_vad": with_(UTT, f"v0 AS (SELECT conv_id, speaker, CAST(round_even(s / 20, 0) AS BIGINT) AS i, CAST(round_even(e / 20, 0) AS BIGINT) AS j FROM utt WHERE label IN ({LIST(SPEECH_LABELS)}))", "v1 AS (SELECT *, max(j)" + SEG.split("v1 AS (SELECT *, max(j)")[1]) + "SELECT * FROM seg",
    "frame_matrix": with_(CONV, SEG, LEN, FR) + """, st AS (SELECT conv_id, f, max(CASE WHEN speaker = 0 THEN 1 ELSE 0 END) AS a, max(CASE WHEN speaker = 1 THEN 1 ELSE 0 END) AS b FROM act GROUP BY 1, 2)
SELECT len.conv_id, any_value(t) - count(f) AS n_none, count(*) FILTER (a = 1 AND b = 0) AS n_only_a, count(*) FILTER (a = 0 AND b = 1) AS n_only_b, count(*) FILTER (a = 1 AND b = 1) AS n_both FROM len LEFT JOIN st ON st.conv_id = len.conv_id GROUP BY 1""",
    "utterance_features": with_(UTT, SPOKEN, VEC) + f""", sl AS (SELECT utt_id, vec.f - a AS f, vec.vec[1] AS v FROM (SELECT utt_id, {NUM.format('conv_id')} AS conv, s * {HZ} // 1000 AS a, greatest(s * {HZ} // 1000 + 2, CAST(ceil(e * {HZ} / 1000) AS BIGINT)) AS b FROM sk) u JOIN vec ON vec.conv = u.conv AND vec.f >= a AND vec.f < b),
nn AS (SELECT utt_id, count(*) AS n, CAST(floor(count(*) / ({HZ} / 13)) AS BIGINT) AS n_out FROM sl GROUP BY 1), ii AS (SELECT *, unnest(generate_series(0, n_out - 1)) AS i FROM nn)
SELECT ii.utt_id, CAST(any_value(n) AS INT) AS n, CAST(any_value(n_out) AS INT) AS n_out, round(sum(CAST(v AS DOUBLE)), 4) AS first FROM ii JOIN sl ON sl.utt_id = ii.utt_id AND sl.f = least(CAST(floor(i * ({HZ} / 13) + {HZ} / 13 / 2) AS BIGINT), n - 1) GROUP BY 1""",
    "aligned_stats": with_(UTT, pi.TOK, pi.BAD, KEPT, pi.sched("(4)").replace("tok.*", "kt.*").replace("FROM tok JOIN ln ON ln.conv_id = tok.conv_id", "FROM kt JOIN ln ON ln.conv_id = kt.conv_id"), pi.STATS) + "SELECT conv_id, chunks, tokens, overflow_tokens, distinct_overflow, max_backlog FROM st",
    "tokens_in_windows": with_(CONV, SEG, LEN, WIN, UTT, pi.TOK) + f"SELECT win.conv_id, win, count(*) AS n, CAST(sum(end_ms - start * 20) AS BIGINT) AS ms FROM win JOIN tok ON tok.conv_id = win.conv_id AND end_ms >= start * 20 AND end_ms < (start + {WINDOW}) * 20 GROUP BY 1, 2",
    "interleaved_starts": with_(UTT, pi.TOK, pi.BAD) + f""", top AS (SELECT conv_id, max(e) AS e FROM utt GROUP BY 1),
grid AS (SELECT conv_id, CAST(unnest(generate_series(0, (e - {SPAN_MS}) // 1000)) * 1000 AS BIGINT) AS start FROM top WHERE e >= {SPAN_MS}),
fr AS (SELECT * FROM grid g WHERE NOT EXISTS (SELECT 1 FROM utt u WHERE u.conv_id = g.conv_id AND u.s - 500 <= g.start AND g.start < u.e + 500)
  AND NOT EXISTS (SELECT 1 FROM utt u WHERE u.conv_id = g.conv_id AND u.utt_id IN (SELECT utt_id FROM bad) AND u.s < g.start + {SPAN_MS} AND u.e > g.start)),
so AS (SELECT *, start // 1000 AS k, row_number() OVER (PARTITION BY conv_id ORDER BY ((start // 1000) * 7919) % 100003, start) AS r FROM fr)
SELECT conv_id, start, [2, 3, 4, 6][({NUM.format('conv_id')} * 31 + k * 17) % 4 + 1] AS delay FROM so WHERE r <= 3 ORDER BY (({NUM.format('conv_id')} * 131 + k) * 7919) % 100003, conv_id, k LIMIT 300""",
    "special_tokens": "SELECT name, CAST(50256 + row_number() OVER () AS INT) AS id FROM (SELECT unnest([" + LIST(ops.SPECIALS) + "]) AS name)",
    "sequence_shares": pi.SQL["model_sequence"].rsplit("SELECT conv_id, kind", 1)[0] + "SELECT conv_id, count(*) AS n, round(count(*) FILTER (kind = 'next') / count(*) FILTER (label <> -100), 6) AS next_share FROM ps GROUP BY 1",
    "collated": with_(UTT, pi.TOK) + ", n AS (SELECT conv_id, utt_id, count(*) AS n FROM tok GROUP BY 1, 2) SELECT utt_id, CAST(max(n) OVER (PARTITION BY conv_id) AS INT) AS size, CAST(max(n) OVER (PARTITION BY conv_id) - n AS INT) AS n_pad FROM n",
    "budget_report": with_(UTT, pi.TOK, pi.sched("(1), (2), (3), (4)"), pi.STATS) + """, f AS (SELECT m, count(*) AS k FROM (SELECT DISTINCT conv_id, m, e FROM sc WHERE e < n_chunks) GROUP BY 1)
SELECT st.m, round(sum(overflow_tokens) / sum(tokens), 6) AS overflow, max(max_backlog) AS max_backlog, round(1 - any_value(k) / sum(chunks), 6) AS silent FROM st JOIN f ON f.m = st.m GROUP BY 1""",
    "worst_utterances": with_(UTT, pi.TOK, pi.BAD) + "SELECT bad.utt_id, reason, CAST(n AS BIGINT) AS n FROM bad JOIN sm ON sm.utt_id = bad.utt_id ORDER BY n DESC, bad.utt_id LIMIT 3",
}
_after = SQL["aligned_stats"].rsplit("SELECT conv_id", 1)[0]
SQL["qc_before_after"] = f"SELECT false AS qc, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(overflow_tokens) AS BIGINT) AS overflow_tokens, max(max_backlog) AS max_backlog FROM ({pi.SQL['interleave_stats']}) UNION ALL SELECT true, CAST(sum(tokens) AS BIGINT), CAST(sum(overflow_tokens) AS BIGINT), max(max_backlog) FROM ({SQL['aligned_stats']})"
