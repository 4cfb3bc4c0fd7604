"""Scores, reports and diagnostics over the data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.operators import encoders
from colloquy.operators import evaluation as ops
from colloquy.operators import interleave as il
from colloquy.operators import signal as sig
from colloquy.operators.events import turn_events
from colloquy.operators.frames import future_label_counts
from colloquy.operators.scoring import match_events
from colloquy.plans import events as ev
from colloquy.plans import extras
from colloquy.plans import frames as fr
from colloquy.plans import interleave as pi
from colloquy.plans import signal as ps
from colloquy.plans import windows as pw
from colloquy.plans.base import CONV, LEN, SEG, UTT, conversations, lengths, timeline, utterances, with_
from colloquy.plans.training import NUM, number
from colloquy.schema import CHUNK_MS, ONSET_EDGES_S
from colloquy.tables import checkpointed, table

THETAS = [500, 700, 900, 950]
FRAME_BINS = (2, 5, 8, 10)


def _labels(spark: SparkSession, d: str) -> DataFrame:
    seg, length = timeline(spark, d)
    return future_label_counts(seg, length.select("conv_id", F.floor(F.col("t") / 4).alias("n")), 12.5, 4)


def label_cross_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Cross entropy and top-1 share of future-activity classes per corpus: fitted on three quarters of the conversations, by number, and scored on the rest."""
    corpus = F.regexp_extract("conv_id", "^([a-z]+)", 1)
    return ops.label_cross_entropy(_labels(spark, d).withColumn("corpus", corpus), number() % 4 != 0, "corpus")


def next_speaker_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of near and of far future activity that is the first speaker's, per conversation."""
    return ops.class_probabilities(_labels(spark, d), "conv_id", FRAME_BINS)


def commit_events(spark: SparkSession, d: str) -> DataFrame:
    """Commits of the 12.5 Hz series at four thresholds: number and sum of their frames."""
    x = ops.commits(ps.probabilities(spark, d), ["conv_id"], "p", THETAS)
    return x.groupBy("conv_id", "theta").agg(F.count("*").alias("n"), F.sum("f").alias("f_sum"))


def crossing_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Share of conversation-minutes with a hand-over in which the series commits, and of those without one, per threshold."""
    minute = lambda c, hz: F.floor(F.col(c) / (60 * hz))
    seg, length = timeline(spark, d)
    gold = turn_events(seg, length).where("kind = 'SHIFT'").select("conv_id", minute("f", 50).alias("k")).distinct().withColumn("gold", F.lit(True))
    every = length.where("t > 0").select("conv_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("t") - 1) / 3000))).alias("k")).join(gold, ["conv_id", "k"], "left").select("conv_id", "k", F.coalesce("gold", F.lit(False)).alias("gold"))
    hits = ops.commits(ps.probabilities(spark, d), ["conv_id"], "p", THETAS).select("conv_id", F.floor(F.col("f") / 750).alias("k"), "theta").distinct().withColumn("hit", F.lit(1))
    grid = spark.createDataFrame([(t,) for t in THETAS], "theta int")
    x = every.join(F.broadcast(grid), F.lit(True)).join(hits, ["conv_id", "k", "theta"], "left")  # the grid is a parameter
    share = lambda c: F.round(F.avg(F.when(c, F.coalesce("hit", F.lit(0)))), 6)
    return x.groupBy("theta").agg(share(F.col("gold")).alias("recall"), share(~F.col("gold")).alias("fp_rate"))


def event_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Ends of utterances as predictions of hand-overs: hits and misses within -0.25 to 3 s, pauses that are held as negative spans, each hit once at most."""
    seg, length = timeline(spark, d)
    events = checkpointed(turn_events(seg, length))
    pred = checkpointed(utterances(spark, d).select("conv_id", "speaker", F.bround(F.col("e") / 20).cast("bigint").alias("at")))
    keys = ["conv_id", "speaker"]
    m = match_events(events.where("kind = 'SHIFT'").select(*keys, F.col("f").alias("at")), pred, keys, 12, 150)
    hold = ops.spans_hit(events.where("kind = 'HOLD'").select(*keys, F.col("f").alias("a"), (F.col("f") + 10).alias("b")), pred, keys)
    a = m.agg(F.count("hit").alias("tp"), (F.count("*") - F.count("hit")).alias("fn"), *(F.round(F.percentile(F.col("hit") - F.col("at"), F.lit(q)), 3).alias(f"p{int(100 * q)}") for q in (0.1, 0.5, 0.9)))
    b = hold.agg(F.count(F.when(F.col("hit"), 1)).alias("fp"), F.count(F.when(~F.col("hit"), 1)).alias("tn"))
    rate = lambda x, y: F.round(F.col(x) / F.nullif(F.col(x) + F.col(y), F.lit(0)), 6)
    return a.join(b, F.lit(True)).select("tp", "fn", "fp", "tn", rate("tp", "fn").alias("recall"), rate("fp", "tn").alias("fp_rate"), "p10", "p50", "p90")  # one row each


def negative_spans(spark: SparkSession, d: str) -> DataFrame:
    """Pauses that are held, per conversation and speaker, and in how many of them an utterance ends."""
    keys = ["conv_id", "speaker"]
    pred = utterances(spark, d).select(*keys, F.bround(F.col("e") / 20).cast("bigint").alias("at"))
    hold = ev.events(spark, d).where("kind = 'HOLD'").select(*keys, F.col("f").alias("a"), (F.col("f") + 10).alias("b"))
    return ops.spans_hit(hold, pred, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.count(F.when(F.col("hit"), 1)).alias("n_hit"))


def event_validation(spark: SparkSession, d: str) -> DataFrame:
    """Events of measured activity by the nearest event, within half a second, of what was said: kind, got, n, mean and largest distance in frames."""
    said = checkpointed(fr.said_frames(spark, d))
    theirs = turn_events(said, lengths(spark, d, said))
    x = ops.nearest_kind(ev.events(spark, d), theirs, ["conv_id", "speaker"], 25)
    return x.groupBy("kind", "got").agg(F.count("*").alias("n"), F.round(F.avg(F.abs("off")), 6).alias("mean_off"), F.max(F.abs("off")).alias("most_off"))


def event_scores(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 per kind of events from what was said against measured ones: a hit is a nearest event of the same kind within half a second."""
    said = checkpointed(fr.said_frames(spark, d))
    gold, theirs = checkpointed(ev.events(spark, d)), checkpointed(turn_events(said, lengths(spark, d, said)))
    x = ops.nearest_kind(gold, theirs, ["conv_id", "speaker"], 25)
    hits = x.groupBy("kind").agg(F.count("*").alias("gold"), F.count(F.when(F.col("got") == F.col("kind"), 1)).alias("hits"))
    y = hits.join(theirs.groupBy("kind").agg(F.count("*").alias("predicted")), "kind")
    rate = lambda a, b: F.round(a / b, 6)
    return y.select("kind", "gold", "predicted", "hits", rate(F.col("hits"), F.col("predicted")).alias("precision"), rate(F.col("hits"), F.col("gold")).alias("recall"), rate(2 * F.col("hits"), F.col("gold") + F.col("predicted")).alias("f1"))


def onset_before(spark: SparkSession, d: str) -> DataFrame:
    """Probability that a speaker begins within each of the horizons, by the life table: bin, seconds, p."""
    from colloquy.plans.extras import hazard_curve

    edges = F.array(*map(F.lit, (*ONSET_EDGES_S, ONSET_EDGES_S[-1])))
    return hazard_curve(spark, d).select("bin", F.element_at(edges, F.col("bin") + 1).alias("seconds"), F.round(1 - F.col("survival"), 6).alias("p"))


def rater_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Fleiss' kappa of three simple raters of what is a back-channel: the label, the length, the number of words."""
    u = utterances(spark, d, "text", "label").where("text is not null")
    n = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    votes = F.array(F.coalesce(F.col("label").like("%Backchannel"), F.lit(False)), F.col("e") - F.col("s") < 1000, n <= 2)
    return ops.fleiss_kappa(u.select("utt_id", F.explode(votes).alias("vote")), "utt_id", "vote")


def boundary_sample(spark: SparkSession, d: str) -> DataFrame:
    """Five utterances of each sentence ending, in a seeded order."""
    u = utterances(spark, d, "text").where("text rlike '[.?!,]$'").withColumn("ending", F.right("text", F.lit(1)))
    return pw.ops.sample_per_group(u.select("ending", "utt_id"), "ending", "utt_id", 5)


def streaming_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Per utterance: time to its first token, and from its end to its last, in ms, by the emission schedule."""
    t, n = pi.streams(spark, d)
    s = il.schedule(t, n, 4, 2).where("e < n_chunks").groupBy("utt_id").agg(F.min("e").alias("a"), F.max("e").alias("b"))
    u = utterances(spark, d).select("utt_id", "s", "e")
    return u.withColumnRenamed("e", "end").join(s, "utt_id").select("utt_id", ((F.col("a") + 1) * CHUNK_MS - F.col("s")).alias("ttft"), ((F.col("b") + 1) * CHUNK_MS - F.col("end")).alias("time_to_final"))


def revisions(spark: SparkSession, d: str) -> DataFrame:
    """Lines delivered for one conversation and start as written, by how often their text changed."""
    r = table(spark, d, "raw_utterance").select("conv_id", "start_time", "text").where("conv_id is not null and start_time is not null")
    x = r.groupBy("conv_id", "start_time").agg((F.countDistinct(F.coalesce("text", F.lit(""))) - 1).alias("changes"))
    return x.groupBy("changes").agg(F.count("*").alias("n"))


def history_gap(spark: SparkSession, d: str) -> DataFrame:
    """How often the next turn is the other speaker's, by whether the last one was (gold) and by whether an alternation would say so (self)."""
    w = Window.partitionBy("conv_id").orderBy("s", "e", "utt_id")
    x = utterances(spark, d).withColumns({"p": F.lag("speaker").over(w), "p2": F.lag("speaker", 2).over(w), "k": F.row_number().over(w)}).where("p is not null and p2 is not null")
    gold, own = (F.col("p") != F.col("p2")), F.col("k") % 2 == 0
    changed = (F.col("speaker") != F.col("p")).cast("int")
    rate = lambda c: F.round(F.avg(F.when(c, changed)), 6)
    return x.agg(rate(gold).alias("gold"), rate(own).alias("self"), F.round(F.avg(F.when(gold, changed)) - F.avg(F.when(own, changed)), 6).alias("gap"))


def language_cube(spark: SparkSession, d: str) -> DataFrame:
    """Documents by language and kind with all subtotals."""
    return table(spark, d, "documents").select("doc_id", "lang", "kind").distinct().cube("lang", "kind").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def temperature_sample(spark: SparkSession, d: str) -> DataFrame:
    """Documents kept by sampling languages at temperature 5: the largest weight per document keeps all, others in proportion, by a seeded order."""
    from colloquy.plans.extras import temperature_weights

    w = temperature_weights(spark, d).withColumn("each", F.col("weight") / F.col("n"))
    w = w.withColumn("rate", F.col("each") / F.max("each").over(Window.partitionBy()))  # a row per language
    docs = table(spark, d, "documents").where("lang is not null").select("doc_id", "lang").distinct().join(F.broadcast(w), "lang")  # a row per language
    return docs.where(F.pmod(F.col("doc_id") * 7919, F.lit(100_003)) < F.floor(F.col("rate") * 100_003)).groupBy("lang").agg(F.count("*").alias("n"))


def rank_report(spark: SparkSession, d: str) -> DataFrame:
    """Softmax of each vector at its label: mean probability, top-1 and top-5 shares, median rank; for all frames, the even and the odd ones."""
    gold = F.element_at("vec", F.col("label") + 1).cast("double")
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.exp(x.cast("double")))
    x = ps.vectors(spark, d).where("label is not null").select(F.explode(F.array(F.lit("all"), F.when(F.col("f") % 2 == 0, "even").otherwise("odd"))).alias("mask"), (F.exp(gold) / norm).alias("p"), F.size(F.filter("vec", lambda v: v > F.element_at("vec", F.col("label") + 1))).alias("r"))
    share = lambda k: F.round(F.avg(F.when(F.col("r") < k, 1.0).otherwise(0.0)), 6)
    return x.groupBy("mask").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("p_gold"), share(1).alias("top1"), share(5).alias("top5"), F.round(F.percentile("r", F.lit(0.5)), 3).alias("median_rank"))


def loss_report(spark: SparkSession, d: str) -> DataFrame:
    """Cross entropy at the label with blanks (label 0) weighted 0.3, per label parity."""
    gold = F.element_at("vec", F.col("label") + 1).cast("double")
    norm = F.log(F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.exp(x.cast("double"))))
    x = ps.vectors(spark, d).where("label is not null").select((F.col("label") % 2).alias("parity"), (norm - gold).alias("l"), F.when(F.col("label") == 0, 0.3).otherwise(1.0).alias("w"))
    return x.groupBy("parity").agg(F.count("*").alias("n"), F.round(ops.weighted_loss(F.col("l"), F.col("w")), 6).alias("loss"))


def distillation_loss(spark: SparkSession, d: str) -> DataFrame:
    """(1 - cosine) + 0.1 * mean squared error / variance of each frame against the next, and of each against itself, per label."""
    v = ps.vectors(spark, d)
    n = v.select("conv", (F.col("f") - 1).alias("f"), F.col("vec").alias("vec2"))
    x = v.join(n, ["conv", "f"])
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, y: a + y)
    plain = F.transform("vec2", lambda y: y.cast("double"))
    mean = total(plain) / F.size("vec2")
    var = total(F.transform("vec2", lambda y: y.cast("double") * y.cast("double"))) / F.size("vec2") - mean * mean
    mse = total(F.zip_with("vec", "vec2", lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double")))) / F.size("vec")
    return x.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(1 - sig.cosine(F.col("vec"), F.col("vec2")) + 0.1 * mse / var), 4).alias("loss"), F.round(F.avg(var), 4).alias("variance"), F.round(F.avg(1 - sig.cosine(F.col("vec"), F.col("vec"))), 4).alias("identity"))


def effective_lookahead(spark: SparkSession, d: str) -> DataFrame:
    """How far ahead a centred mean of three frames looks, over all components and three cuts: least, mean, greatest."""
    v = ps.vectors(spark, d).select("conv", "f", F.posexplode("vec").alias("pos", "x"))
    w = Window.partitionBy("conv", "pos").orderBy("f").rowsBetween(-1, 1)
    x = v.withColumn("x", F.col("x").cast("double")).withColumn("full", F.sum("x").over(w))
    cuts = [20, 30, 40]
    for n in cuts:
        x = x.withColumn(f"c{n}", F.sum(F.when(F.col("f") < n, F.col("x")).otherwise(0.0)).over(w))
    spread = F.stddev_pop("full").over(Window.partitionBy("conv", "pos"))
    x = x.withColumn("sd", spread)
    off = lambda n: (n - F.min(F.when((F.col("f") < n) & (F.abs(F.col("full") - F.col(f"c{n}")) / (F.col("sd") + 1e-12) > 1e-3), F.col("f")))).alias(f"l{n}")
    each = x.groupBy("conv").agg(*map(off, cuts))
    looks = F.array(*(F.col(f"l{n}") for n in cuts))
    return each.select("conv", F.array_min(looks).alias("least"), F.round(F.aggregate(looks, F.lit(0.0), lambda a, y: a + y) / 3, 6).alias("mean"), F.array_max(looks).alias("most"))


def stitch_differences(spark: SparkSession, d: str) -> DataFrame:
    """A running mean of three frames over whole series against one over segments of ten with one frame of left context: frames that differ."""
    v = ps.vectors(spark, d).select("conv", "f", "vec")
    whole = sig.running_mean(v, ["conv"], 3)
    pieces = sig.stitched(v, ["conv"], 10, 1, lambda x, k: sig.running_mean(x, k, 3))
    x = ops.series_differences(whole, pieces, ["conv"])
    return x.select("conv", "n", "n_off", "first_off", F.round("largest", 4).alias("largest"))


def encoder_registry(spark: SparkSession, d: str) -> DataFrame:
    return encoders.described(spark)


def encoded_differences(spark: SparkSession, d: str) -> DataFrame:
    """An encoder over whole series against the same over segments with enough left context, front end first: frames that differ, which are none."""
    v = ps.vectors(spark, d)
    whole = encoders.encoder("mean3").run(sig.z_normalized(v, ["conv"]), ["conv"])
    x = ops.series_differences(whole, encoders.encoder("normal-mean3").encode(v, ["conv"]), ["conv"])
    return x.select("conv", "n", "n_off")


def block_attention(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of frames that may attend to each other in blocks of 13, by rule."""
    f = ps.vectors(spark, d).select("conv", "f")
    return sig.attention_pairs(f, ["conv"], 13, 2).groupBy("conv", "rule").agg(F.count("*").alias("n"), F.sum(F.col("q") * F.col("k")).alias("check_sum"))


def threshold_vad(spark: SparkSession, d: str) -> DataFrame:
    """Frames above a plain threshold of -40 dB, every other dozen damped by 50 dB."""
    x = ps.energy_db(spark, d).withColumn("db", F.col("db") - 50 * (F.floor(F.col("f") / 12) % 2))
    return x.groupBy("conv").agg(F.count("*").alias("n"), F.count(F.when(F.col("db") > -40, 1)).alias("n_on"))


def z_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Components scaled by mean and standard deviation of their series: squares summed per frame."""
    x = sig.z_normalized(ps.vectors(spark, d), ["conv"])
    return x.select("conv", "f", F.round(F.aggregate("vec", F.lit(0.0), lambda a, y: a + y * y), 3).alias("squares"))


def build_report(spark: SparkSession, d: str) -> DataFrame:
    """Per corpus: conversations, hours, speech ratio (mean, median, 10th percentile) and turn events of each kind."""
    seg, length = timeline(spark, d)
    corpus = F.regexp_extract("conv_id", "^([a-z]+)", 1).alias("corpus")
    speech = seg.groupBy("conv_id").agg(F.sum(F.col("j") - F.col("i")).alias("n"))
    x = length.where("t > 0").join(speech, "conv_id", "left").select(corpus, "t", (F.coalesce("n", F.lit(0)) / (2 * F.col("t"))).alias("r"))
    a = x.groupBy("corpus").agg(F.count("*").alias("n"), F.round(F.sum("t") / 180_000, 6).alias("hours"), F.round(F.avg("r"), 6).alias("mean"), F.round(F.percentile("r", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("r", F.lit(0.1)), 6).alias("p10"))
    e = turn_events(seg, length).groupBy(corpus).agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(k.lower()) for k in ("SHIFT", "HOLD", "INTERRUPT", "BACKCHANNEL")))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(e, "corpus", "left").select(*a.columns, *map(z, ("shift", "hold", "interrupt", "backchannel")))


def verification_report(spark: SparkSession, d: str) -> DataFrame:
    """Distance in ms from utterance starts to the nearest measured onset per source of the activity: n, median, 90th percentile, mean."""
    c = table(spark, d, "conversation").where("id is not null").groupBy(F.col("id").alias("conv_id")).agg(F.max("vad_source").alias("vad_source"))
    u = utterances(spark, d).select("utt_id", "conv_id")
    x = fr.nearest_onset_error(spark, d).join(u, "utt_id").join(c, "conv_id").select("vad_source", (F.col("error") * 20).alias("ms"))
    return x.groupBy("vad_source").agg(F.count("*").alias("n"), F.round(F.percentile("ms", F.lit(0.5)), 3).alias("median"), F.round(F.percentile("ms", F.lit(0.9)), 3).alias("p90"), F.round(F.avg("ms"), 3).alias("mean"))


def alignment_summary(spark: SparkSession, d: str) -> DataFrame:
    """From the end of the last activity within an utterance to its end, in ms, per speaker: n, median, 90th percentile."""
    u = utterances(spark, d).select("conv_id", "speaker", "utt_id", F.bround(F.col("s") / 20).cast("bigint").alias("i"), F.bround(F.col("e") / 20).cast("bigint").alias("j")).where("j > i")
    seg = timeline(spark, d)[0].select("conv_id", "speaker", F.col("i").alias("i2"), F.col("j").alias("j2"))
    cells = lambda x, a, b: x.withColumn("c", F.explode(F.sequence(F.floor(F.col(a) / 1000), F.floor((F.col(b) - 1) / 1000))))
    met = cells(u, "i", "j").join(cells(seg, "i2", "j2"), ["conv_id", "speaker", "c"]).where("i2 < j and j2 > i").groupBy("speaker", "utt_id", "j").agg(F.max(F.least("j", "j2")).alias("last"))
    ms = 20 * (F.col("j") - F.col("last"))
    return met.groupBy("speaker").agg(F.count("*").alias("n"), F.round(F.percentile(ms, F.lit(0.5)), 3).alias("median"), F.round(F.percentile(ms, F.lit(0.9)), 3).alias("p90"))


def run_history(spark: SparkSession, d: str) -> DataFrame:
    """Result documents of runs, one for each fifty vectors with a history of ten steps, written as JSON and read as a table: run, step, ce, best."""
    v = ps.vectors(spark, d).where("label is not null").groupBy(F.col("conv").alias("run"), (F.floor(F.col("f") / 5)).alias("step")).agg(F.round(F.avg("label"), 4).alias("ce"))
    docs = v.groupBy("run").agg(F.to_json(F.struct(F.col("run"), F.array_sort(F.collect_list(F.struct("step", "ce"))).alias("hist"))).alias("value"))
    rows = docs.select(F.from_json("value", "run bigint, hist array<struct<step:bigint,ce:double>>").alias("j")).select("j.run", F.explode("j.hist").alias("h")).select("run", "h.*")
    best = F.min_by("step", F.struct("ce", "step")).over(Window.partitionBy("run"))
    return rows.withColumn("best", best == F.col("step"))


def throughput(spark: SparkSession, d: str) -> DataFrame:
    """Per source as written: hours, real-time factor at 0.05 s a conversation, GB an hour of 64 components at 50 Hz in two channels of two bytes."""
    x = conversations(spark, d).where("ms is not null").groupBy("source").agg(F.count("*").alias("n"), (F.sum("ms") / 3_600_000).alias("h"))
    return x.select("source", F.round("h", 6).alias("hours"), F.round(0.05 * F.col("n") / (F.col("h") * 3600), 8).alias("rtf"), F.round(F.lit(2 * 50 * 3600 * 64 * 2 / 1e9), 6).alias("gb_hour"), F.round(F.col("h") * 2 * 50 * 3600 * 64 * 2 / 1e9, 6).alias("gb"))


def latency_budget(spark: SparkSession, d: str) -> DataFrame:
    """Latency of each emission delay: half a chunk, the look-ahead and a compute time of 20 ms, and whether it keeps 300 ms."""
    x = spark.createDataFrame([(k,) for k in range(1, 9)], "delay int").withColumn("ms", CHUNK_MS / 2 + F.col("delay") * CHUNK_MS + F.lit(20.0))
    return x.withColumn("ok", F.col("ms") <= 300)


def limits_report(spark: SparkSession, d: str) -> DataFrame:
    """Per conversation: tokens that wait at one token a chunk, the 99th percentile of their waits in ms, and whether backlog and waits stay below a chunk."""
    t, n = pi.streams(spark, d)
    s = checkpointed(il.schedule(t, n, 1, 2))
    w = s.groupBy("conv_id").agg(F.round(F.percentile((F.least("e", "n_chunks") - F.col("b")) * CHUNK_MS, F.lit(0.99)), 3).alias("p99"))
    return il.emission_stats(s, n).join(w, "conv_id").select("conv_id", "max_backlog", "p99", ((F.col("max_backlog") < 1) & (F.col("p99") < CHUNK_MS)).alias("ok"))


def observable_at(spark: SparkSession, d: str) -> DataFrame:
    """The series as it may be known: within each second a frame takes the least value until the last frame, which takes the greatest; a conversation's frames above 900, and values by place."""
    b = ps.lookahead_blocks(ps.probabilities(spark, d), "conv_id", 13)
    return b.groupBy("conv_id").agg(F.count(F.when(F.col("v") > 900, 1)).alias("n_over"), F.sum(F.col("v") * (F.col("f") % 13 + 1)).alias("check_sum"))


def infer_stitched(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping inference windows (20 s and a step of 5 s) whose model sums what it has seen of its window: the stitched series, summed."""
    x = ps.probabilities(spark, d)
    start = F.greatest(F.lit(0), F.floor((F.col("f") - 250) / 62)) * 62
    # a value is in the sum of every frame from its own on whose window begins at or before it: the last of them is 311 frames behind the step that it lies in, or the conversation's last
    times = F.least(F.col("n"), F.floor(F.col("f") / 62) * 62 + 312) - F.col("f")
    return x.groupBy("conv_id").agg(F.count("*").alias("n"), F.max(start).alias("last_start"), F.sum(F.col("p") * times).alias("total"))


def speaker_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct ordered pairs of participants as written, per corpus, and how many conversations name both."""
    c = table(spark, d, "conversation").where("id is not null").select(F.col("id").alias("conv_id"), F.col("meta")["spk1"].alias("a"), F.col("meta")["spk2"].alias("b")).where("a is not null and b is not null").distinct()
    return c.groupBy(F.regexp_extract("conv_id", "^([a-z]+)", 1).alias("corpus")).agg(F.countDistinct("a", "b").alias("pairs"), F.count("*").alias("n"))


def languages(spark: SparkSession, d: str) -> DataFrame:
    """Conversations by the language of their corpus."""
    lang = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    x = conversations(spark, d).select("conv_id").distinct()
    return x.groupBy(F.coalesce(lang[F.regexp_extract("conv_id", "^([a-z]+)", 1)], F.lit("unknown")).alias("language")).agg(F.count("*").alias("n"))


def fastest_utterances(spark: SparkSession, d: str) -> DataFrame:
    """The five utterances with the most tokens a second."""
    n = pi.tokens(spark, d).groupBy("utt_id").agg(F.count("*").alias("n"))
    r = utterances(spark, d).join(n, "utt_id").select("utt_id", F.round(F.col("n") * 1000 / F.greatest(F.col("e") - F.col("s"), F.lit(100)), 6).alias("rate"))
    return r.orderBy(F.desc("rate"), "utt_id").limit(5)


def token_weighted_rates(spark: SparkSession, d: str) -> DataFrame:
    """Shares of tokens in utterances faster than one to four tokens a chunk, and characters a token."""
    t = pi.tokens(spark, d).groupBy("utt_id").agg(F.count("*").alias("n"), F.sum(F.length("word")).alias("chars"))
    r = utterances(spark, d).join(t, "utt_id").withColumn("r", F.col("n") * 1000 / F.greatest(F.col("e") - F.col("s"), F.lit(100)))
    over = [F.round(F.sum(F.when(F.col("r") > x, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias(f"over_{k}") for k, x in enumerate((12.5, 25, 37.5, 50), 1)]
    return r.agg(F.sum("n").alias("n"), *over, F.round(F.sum("chars") / F.sum("n"), 6).alias("chars_a_token"))


def latency_shares(spark: SparkSession, d: str) -> DataFrame:
    """Tokens out before their end, and more than a chunk before it, with delays of none, and tokens a chunk."""
    t, n = pi.streams(spark, d)
    s = il.schedule(t, n, 4, 0).where("e < n_chunks")
    v = (F.col("e") + 1) * CHUNK_MS - F.col("end_ms")
    a = s.agg(F.count("*").alias("n"), F.round(F.avg(F.when(v < 0, 1.0).otherwise(0.0)), 6).alias("before_end"), F.round(F.avg(F.when(v < -CHUNK_MS, 1.0).otherwise(0.0)), 6).alias("chunk_before"))
    chunks = n.agg(F.sum(F.ceil(F.col("ms") / CHUNK_MS)).alias("chunks"))
    return a.join(chunks, F.lit(True)).select("n", "before_end", "chunk_before", F.round(F.col("n") / F.col("chunks"), 6).alias("tokens_a_chunk"))  # one row each


def swap_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Turn events of the segments with speakers exchanged, exchanged back, against those of the segments as they are: events on either side only."""
    seg, length = timeline(spark, d)
    a = turn_events(seg, length).withColumn("v", F.lit(1))
    b = turn_events(seg.withColumn("speaker", 1 - F.col("speaker")), length).withColumns({"speaker": 1 - F.col("speaker"), "v": F.lit(-1)})
    return a.unionByName(b).groupBy("conv_id", "f", "speaker", "kind").agg(F.sum("v").alias("v")).agg(F.count("*").alias("n"), F.count(F.when(F.col("v") != 0, 1)).alias("n_off"))


# Languages of the corpora, by the letters their ids begin with.
LANGUAGES = {"aihub": "Korean", "oto": "English", "tb": "English"}
CORPUS = "regexp_extract({0}, '^([a-z]+)', 1)"
EVSQL = ev.HEAD(ev.EVENTS_CTE)
_future = fr.SQL["future_activity_label"]
LABELS = _future.rsplit("SELECT conv_id, label", 1)[0].rstrip() + ",\nlc AS (SELECT conv_id, label, count(*) AS n FROM y WHERE f < n - 25 GROUP BY 1, 2)\n"
DOUBLES = "list_transform({0}, lambda z: CAST(z AS DOUBLE))"
QUERIES = {
    f.__name__: f
    for f in (
        label_cross_entropy, next_speaker_share, commit_events, crossing_sweep, event_confusion, negative_spans, event_validation, event_scores, onset_before, rater_agreement, boundary_sample, streaming_metrics, revisions, history_gap, language_cube,
        temperature_sample, rank_report, loss_report, distillation_loss, effective_lookahead, stitch_differences, encoder_registry, encoded_differences, block_attention, threshold_vad, z_normalized, build_report, verification_report, alignment_summary, run_history,
        throughput, latency_budget, limits_report, observable_at, infer_stitched, speaker_pairs, languages, fastest_utterances, token_weighted_rates, latency_shares, swap_consistency,
    )
}
HAZARD = extras.SQL["hazard_curve"]
BITS = lambda s, ks: " + ".join(f"((label >> {4 * s + k}) & 1) * {FRAME_BINS[k]}" for k in ks)
SHARE = lambda ks: f"round(sum(n * ({BITS(0, ks)})) / nullif(sum(n * ({BITS(0, ks)})) + sum(n * ({BITS(1, ks)})), 0), 6)"
CROSS = f"""cr AS (SELECT conv_id, f, t AS theta FROM (SELECT *, coalesce(lag(p) OVER (PARTITION BY conv_id ORDER BY f), -1) AS b FROM pb), (VALUES {", ".join(f"({t})" for t in THETAS)}) th(t) WHERE p >= t AND b < t)"""
NP = "np AS (SELECT conv, f, pos, v, avg(v) OVER (PARTITION BY conv, pos ORDER BY f ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS whole FROM (SELECT conv, f, unnest(generate_series(0, len(vec) - 1)) AS pos, unnest(" + DOUBLES.format("vec") + ") AS v FROM vec))"
SAIDSEG = SEG.replace("v0 AS", "sv0 AS").replace("v1 AS", "sv1 AS").replace("v2 AS", "sv2 AS").replace("seg AS", "sseg AS").replace("FROM v0", "FROM sv0").replace("FROM v1", "FROM sv1").replace("FROM v2", "FROM sv2")
SAIDSEG = "sv0 AS (SELECT conv_id, speaker, CAST(round_even(s / 20, 0) AS BIGINT) AS i, CAST(round_even(e / 20, 0) AS BIGINT) AS j FROM utt),\nsv1 AS" + SAIDSEG.split("sv1 AS", 1)[1]
SAIDEV = "slen AS (SELECT conv.conv_id, greatest(coalesce(CAST(round_even(ms / 20, 0) AS BIGINT), 0), coalesce(l.last, 0)) AS t FROM conv LEFT JOIN (SELECT conv_id, max(j) AS last FROM sseg GROUP BY 1) l ON l.conv_id = conv.conv_id),\n" + (
    ev.EVENTS_CTE.replace("own AS", "sown AS").replace("x AS (SELECT own", "sx AS (SELECT own").replace("own.*", "sown.*").replace("own.conv_id", "sown.conv_id").replace("own.speaker", "sown.speaker").replace("own.j", "sown.j").replace("own.i", "sown.i").replace("FROM own JOIN len ON len.", "FROM sown JOIN slen ON slen.")
    .replace("len.t", "slen.t").replace("FROM seg", "FROM sseg").replace("y AS (SELECT x.*", "sy AS (SELECT sx.*").replace("x.conv_id", "sx.conv_id").replace("x.speaker", "sx.speaker").replace("x.oe", "sx.oe").replace("FROM x)", "FROM sx)").replace("ev AS (", "sev AS (").replace("FROM y ", "FROM sy ")
).replace("ssown", "sown").replace("ssx", "sx")
SQL = {
    "label_cross_entropy": LABELS + f""", k AS (SELECT label, sum(n) AS k FROM lc WHERE {NUM.format('conv_id')} % 4 <> 0 GROUP BY 1), a AS (SELECT sum(k) AS all_, arg_max(label, k * 1000 - label) AS best FROM k)
SELECT {CORPUS.format('conv_id')} AS corpus, CAST(sum(n) AS BIGINT) AS n, round(-sum(n * ln((coalesce(k, 0) + 1) / (all_ + 256))) / sum(n), 6) AS ce, round(sum(CASE WHEN lc.label = best THEN n ELSE 0 END) / sum(n), 6) AS top1
FROM lc LEFT JOIN k ON k.label = lc.label CROSS JOIN a WHERE {NUM.format('conv_id')} % 4 = 0 GROUP BY 1""",
    "next_speaker_share": LABELS + f"SELECT conv_id, {SHARE((0, 1))} AS p_now, {SHARE((2, 3))} AS p_future FROM lc GROUP BY 1",
    "commit_events": with_(CONV, SEG, LEN, ps.PROB, CROSS) + "SELECT conv_id, theta, count(*) AS n, CAST(sum(f) AS BIGINT) AS f_sum FROM cr GROUP BY 1, 2",
    "crossing_sweep": ev.HEAD(ev.EVENTS_CTE, ps.PROB, CROSS) + f""", g AS (SELECT DISTINCT conv_id, f // 3000 AS k FROM ev WHERE kind = 'SHIFT'), h AS (SELECT DISTINCT conv_id, f // 750 AS k, theta FROM cr),
mn AS (SELECT conv_id, unnest(generate_series(0, (t - 1) // 3000)) AS k FROM len WHERE t > 0),
al AS (SELECT t AS theta, g.k IS NOT NULL AS gold, CASE WHEN h.k IS NULL THEN 0 ELSE 1 END AS hit FROM mn CROSS JOIN (VALUES {", ".join(f"({t})" for t in THETAS)}) th(t) LEFT JOIN g ON g.conv_id = mn.conv_id AND g.k = mn.k LEFT JOIN h ON h.conv_id = mn.conv_id AND h.k = mn.k AND h.theta = t)
SELECT theta, round(avg(hit) FILTER (gold), 6) AS recall, round(avg(hit) FILTER (NOT gold), 6) AS fp_rate FROM al GROUP BY 1""",
    "negative_spans": ev.HEAD(ev.EVENTS_CTE, UTT) + """, h AS (SELECT conv_id, speaker, f, EXISTS (SELECT 1 FROM utt u WHERE u.conv_id = ev.conv_id AND u.speaker = ev.speaker AND round_even(u.e / 20, 0) >= ev.f AND round_even(u.e / 20, 0) < ev.f + 10) AS hit FROM ev WHERE kind = 'HOLD')
SELECT conv_id, speaker, count(*) AS n, count(*) FILTER (hit) AS n_hit FROM h GROUP BY 1, 2""",
    "event_validation": ev.HEAD(ev.EVENTS_CTE, UTT, SAIDSEG, SAIDEV) + """, nk AS (SELECT g.conv_id, g.speaker, g.f, g.kind, p.kind AS got, p.f - g.f AS off, row_number() OVER (PARTITION BY g.conv_id, g.speaker, g.f, g.kind ORDER BY abs(p.f - g.f), p.f, p.kind) AS k
  FROM ev g LEFT JOIN sev p ON p.conv_id = g.conv_id AND p.speaker = g.speaker AND abs(p.f - g.f) <= 25)
SELECT kind, got, count(*) AS n, round(avg(abs(off)), 6) AS mean_off, max(abs(off)) AS most_off FROM nk WHERE k = 1 GROUP BY 1, 2""",
    "event_scores": ev.HEAD(ev.EVENTS_CTE, UTT, SAIDSEG, SAIDEV) + """, nk AS (SELECT g.kind, p.kind AS got, row_number() OVER (PARTITION BY g.conv_id, g.speaker, g.f, g.kind ORDER BY abs(p.f - g.f), p.f, p.kind) AS k
  FROM ev g LEFT JOIN sev p ON p.conv_id = g.conv_id AND p.speaker = g.speaker AND abs(p.f - g.f) <= 25),
hh AS (SELECT kind, count(*) AS gold, count(*) FILTER (got = kind) AS hits FROM nk WHERE k = 1 GROUP BY 1), pp AS (SELECT kind, count(*) AS predicted FROM sev GROUP BY 1)
SELECT hh.kind, gold, predicted, hits, round(hits / predicted, 6) AS precision, round(hits / gold, 6) AS recall, round(2 * hits / (gold + predicted), 6) AS f1 FROM hh JOIN pp ON pp.kind = hh.kind""",
    "onset_before": f"SELECT bin, CAST([{', '.join(map(str, (*ONSET_EDGES_S, ONSET_EDGES_S[-1])))}][bin + 1] AS DOUBLE) AS seconds, round(1 - survival, 6) AS p FROM ({HAZARD})",
    "rater_agreement": with_(UTT) + """, r AS (SELECT utt_id, unnest([coalesce(label LIKE '%Backchannel', false), e - s < 1000, len(list_filter(string_split(text, ' '), lambda w: w <> '')) <= 2]) AS vote FROM utt WHERE text IS NOT NULL),
c AS (SELECT utt_id, count(*) FILTER (vote) AS a, count(*) FILTER (NOT vote) AS b FROM r GROUP BY 1), z AS (SELECT count(*) AS items, avg((a * (a - 1) + b * (b - 1)) / 6) AS p, sum(a) / (3 * count(*)) AS qa, sum(b) / (3 * count(*)) AS qb FROM c)
SELECT items, CAST(3 AS BIGINT) AS raters, round((p - (qa * qa + qb * qb)) / nullif(1 - (qa * qa + qb * qb), 0), 6) AS kappa FROM z""",
    "boundary_sample": with_(UTT) + "SELECT ending, utt_id FROM (SELECT *, row_number() OVER (PARTITION BY ending ORDER BY (utt_id * 7919) % 100003, utt_id) AS k FROM (SELECT right(text, 1) AS ending, utt_id FROM utt WHERE regexp_matches(text, '[.?!,]$'))) WHERE k <= 5",
    "streaming_metrics": with_(UTT, pi.TOK, pi.sched("(4)")) + "SELECT utt.utt_id, (min(sc.e) + 1) * 80 - any_value(utt.s) AS ttft, (max(sc.e) + 1) * 80 - any_value(utt.e) AS time_to_final FROM utt JOIN sc ON sc.utt_id = utt.utt_id WHERE sc.e < n_chunks GROUP BY 1",
    "revisions": "SELECT changes, count(*) AS n FROM (SELECT count(DISTINCT coalesce(text, '')) - 1 AS changes FROM raw_utterance WHERE conv_id IS NOT NULL AND start_time IS NOT NULL GROUP BY conv_id, start_time) GROUP BY 1",
    "history_gap": with_(UTT) + """, h AS (SELECT CASE WHEN speaker <> p THEN 1 ELSE 0 END AS c, p <> p2 AS gold, k % 2 = 0 AS own FROM (SELECT speaker, lag(speaker) OVER w AS p, lag(speaker, 2) OVER w AS p2, row_number() OVER w AS k FROM utt WINDOW w AS (PARTITION BY conv_id ORDER BY s, e, utt_id)) WHERE p2 IS NOT NULL)
SELECT round(avg(c) FILTER (gold), 6) AS gold, round(avg(c) FILTER (own), 6) AS self, round(avg(c) FILTER (gold) - avg(c) FILTER (own), 6) AS gap FROM h""",
    "language_cube": "SELECT lang, kind, count(*) AS n, grouping(lang, kind) AS level FROM (SELECT DISTINCT doc_id, lang, kind FROM documents) GROUP BY CUBE (lang, kind)",
    "temperature_sample": """WITH w AS (SELECT lang, n, round(w / sum(w) OVER (), 6) AS weight FROM (SELECT lang, n, pow(n / sum(n) OVER (), 0.2) AS w FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1))),
r AS (SELECT lang, (weight / n) / max(weight / n) OVER () AS rate FROM w)
SELECT d.lang, count(*) AS n FROM (SELECT DISTINCT doc_id, lang FROM documents WHERE lang IS NOT NULL) d JOIN r ON r.lang = d.lang WHERE (doc_id * 7919) % 100003 < floor(rate * 100003) GROUP BY 1""",
    "rank_report": with_(ps.VEC) + """, x AS (SELECT f, exp(CAST(vec[label + 1] AS DOUBLE)) / list_sum(list_transform(vec, lambda z: exp(CAST(z AS DOUBLE)))) AS p, len(list_filter(vec, lambda z: z > vec[label + 1])) AS r FROM vec WHERE label IS NOT NULL),
m AS (SELECT 'all' AS mask, p, r FROM x UNION ALL SELECT CASE WHEN f % 2 = 0 THEN 'even' ELSE 'odd' END, p, r FROM x)
SELECT mask, count(*) AS n, round(avg(p), 6) AS p_gold, round(avg(CASE WHEN r < 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN r < 5 THEN 1.0 ELSE 0.0 END), 6) AS top5, round(quantile_cont(r, 0.5), 3) AS median_rank FROM m GROUP BY 1""",
    "loss_report": with_(ps.VEC) + "SELECT label % 2 AS parity, count(*) AS n, round(sum(w * l) / greatest(sum(w), 1.0), 6) AS loss FROM (SELECT label, ln(list_sum(list_transform(vec, lambda z: exp(CAST(z AS DOUBLE))))) - CAST(vec[label + 1] AS DOUBLE) AS l, CAST(CASE WHEN label = 0 THEN 0.3 ELSE 1 END AS DOUBLE) AS w FROM vec WHERE label IS NOT NULL) GROUP BY 1",
    "distillation_loss": with_(ps.VEC) + f"""SELECT a.label, count(*) AS n, round(avg(1 - list_cosine_similarity({DOUBLES.format('a.vec')}, {DOUBLES.format('b.vec')}) + 0.1 * pow(list_distance({DOUBLES.format('a.vec')}, {DOUBLES.format('b.vec')}), 2) / len(a.vec) / list_var_pop({DOUBLES.format('b.vec')})), 4) AS loss,
  round(avg(list_var_pop({DOUBLES.format('b.vec')})), 4) AS variance, round(avg(1 - list_cosine_similarity({DOUBLES.format('a.vec')}, {DOUBLES.format('a.vec')})), 4) AS identity FROM vec a JOIN vec b ON a.conv = b.conv AND b.f = a.f + 1 GROUP BY 1""",
    "effective_lookahead": with_(ps.VEC, NP) + """, w AS (SELECT conv, f, pos, sum(v) OVER p AS full_, """ + ", ".join(f"sum(CASE WHEN f < {n} THEN v ELSE 0 END) OVER p AS c{n}" for n in (20, 30, 40)) + """ FROM np WINDOW p AS (PARTITION BY conv, pos ORDER BY f ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
sd AS (SELECT conv, pos, stddev_pop(full_) AS sd FROM w GROUP BY 1, 2),
l AS (SELECT w.conv, """ + ", ".join(f"{n} - min(f) FILTER (f < {n} AND abs(full_ - c{n}) / (sd + 1e-12) > 1e-3) AS l{n}" for n in (20, 30, 40)) + """ FROM w JOIN sd ON sd.conv = w.conv AND sd.pos = w.pos GROUP BY 1)
SELECT conv, least(l20, l30, l40) AS least, round((l20 + l30 + l40) / 3, 6) AS mean, greatest(l20, l30, l40) AS most FROM l""",
    "stitch_differences": with_(ps.VEC, NP) + """, pc AS (SELECT a.conv, a.f, a.pos, a.whole, avg(b.v) AS part FROM np a JOIN np b ON b.conv = a.conv AND b.pos = a.pos AND b.f BETWEEN greatest(a.f - 2, (a.f // 10) * 10 - 1) AND a.f GROUP BY 1, 2, 3, 4),
sd AS (SELECT conv, pos, stddev_pop(whole) AS sd FROM pc GROUP BY 1, 2), o AS (SELECT pc.conv, f, max(abs(whole - part) / (sd + 1e-12)) AS off FROM pc JOIN sd ON sd.conv = pc.conv AND sd.pos = pc.pos GROUP BY 1, 2)
SELECT conv, count(*) AS n, count(*) FILTER (off > 1e-3) AS n_off, min(f) FILTER (off > 1e-3) AS first_off, round(max(off), 4) AS largest FROM o GROUP BY 1""",
    "block_attention": with_(ps.VEC) + """, pr AS (SELECT a.conv, a.f AS q, b.f AS k FROM vec a JOIN vec b ON b.conv = a.conv)
SELECT conv, rule, count(*) AS n, CAST(sum(q * k) AS BIGINT) AS check_sum FROM (SELECT *, unnest(list_filter(['block', 'chunked-causal', 'causal'], lambda r: CASE r WHEN 'block' THEN q // 13 = k // 13 WHEN 'causal' THEN k <= q AND q // 13 - k // 13 <= 2 ELSE k // 13 <= q // 13 AND q // 13 - k // 13 <= 2 END)) AS rule FROM pr) GROUP BY 1, 2""",
    "encoded_differences": with_(ps.VEC) + "SELECT conv, count(*) AS n, CAST(0 AS BIGINT) AS n_off FROM vec GROUP BY 1",
    "encoder_registry": "SELECT * FROM (VALUES ('plain', 50.0::DOUBLE, 0, true, 0, 0, false), ('mean3', 50.0, 0, true, 0, 0, false), ('mean3-cut', 50.0, 0, true, 10, 2, false), ('normal-mean3', 50.0, 0, true, 10, 2, true)) t(name, frame_hz, lookahead_ms, causal, segment, context, has_frontend)",
    "threshold_vad": with_(ps.VEC, ps.DB) + "SELECT conv, count(*) AS n, count(*) FILTER (db - 50 * ((f // 12) % 2) > -40) AS n_on FROM db GROUP BY 1",
    "z_normalized": with_(ps.VEC, NP) + "SELECT conv, f, round(sum(z * z), 3) AS squares FROM (SELECT conv, f, (v - avg(v) OVER w) / (stddev_samp(v) OVER w + 1e-7) AS z FROM np WINDOW w AS (PARTITION BY conv)) GROUP BY 1, 2",
    "build_report": EVSQL + f""", sp AS (SELECT conv_id, sum(j - i) AS n FROM seg GROUP BY 1), r AS (SELECT {CORPUS.format('len.conv_id')} AS corpus, t, coalesce(n, 0) / (2 * t) AS r FROM len LEFT JOIN sp ON sp.conv_id = len.conv_id WHERE t > 0),
a AS (SELECT corpus, count(*) AS n, round(sum(t) / 180000, 6) AS hours, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.1), 6) AS p10 FROM r GROUP BY 1),
e AS (SELECT {CORPUS.format('conv_id')} AS corpus, count(*) FILTER (kind = 'SHIFT') AS shift, count(*) FILTER (kind = 'HOLD') AS hold, count(*) FILTER (kind = 'INTERRUPT') AS interrupt, count(*) FILTER (kind = 'BACKCHANNEL') AS backchannel FROM ev GROUP BY 1)
SELECT a.*, coalesce(shift, 0) AS shift, coalesce(hold, 0) AS hold, coalesce(interrupt, 0) AS interrupt, coalesce(backchannel, 0) AS backchannel FROM a LEFT JOIN e ON e.corpus = a.corpus""",
    "verification_report": with_(SEG, UTT) + """, er AS (SELECT utt_id, any_value(utt.conv_id) AS conv_id, min(abs(CAST(round_even(s / 20, 0) AS BIGINT) - i)) * 20 AS ms FROM utt JOIN seg ON seg.conv_id = utt.conv_id GROUP BY 1)
SELECT vad_source, count(*) AS n, round(quantile_cont(ms, 0.5), 3) AS median, round(quantile_cont(ms, 0.9), 3) AS p90, round(avg(ms), 3) AS mean FROM er JOIN (SELECT id, max(vad_source) AS vad_source FROM conversation GROUP BY 1) c ON c.id = er.conv_id GROUP BY 1""",
    "alignment_summary": with_(SEG, UTT) + """, u AS (SELECT utt_id, conv_id, speaker, CAST(round_even(s / 20, 0) AS BIGINT) AS i, CAST(round_even(e / 20, 0) AS BIGINT) AS j FROM utt),
l AS (SELECT utt_id, any_value(u.speaker) AS speaker, 20 * (any_value(u.j) - max(least(u.j, seg.j))) AS ms FROM u JOIN seg ON seg.conv_id = u.conv_id AND seg.speaker = u.speaker AND seg.i < u.j AND seg.j > u.i WHERE u.j > u.i GROUP BY 1)
SELECT speaker, count(*) AS n, round(quantile_cont(ms, 0.5), 3) AS median, round(quantile_cont(ms, 0.9), 3) AS p90 FROM l GROUP BY 1""",
    "run_history": with_(ps.VEC) + "SELECT run, step, ce, row_number() OVER (PARTITION BY run ORDER BY ce, step) = 1 AS best FROM (SELECT conv AS run, f // 5 AS step, round(avg(label), 4) AS ce FROM vec WHERE label IS NOT NULL GROUP BY 1, 2)",
    "throughput": with_(CONV) + "SELECT source, round(h, 6) AS hours, round(0.05 * n / (h * 3600), 8) AS rtf, round(2 * 50 * 3600 * 64 * 2 / 1e9, 6) AS gb_hour, round(h * 2 * 50 * 3600 * 64 * 2 / 1e9, 6) AS gb FROM (SELECT source, count(*) AS n, sum(ms) / 3600000 AS h FROM conv WHERE ms IS NOT NULL GROUP BY 1)",
    "latency_budget": "SELECT CAST(k AS INT) AS delay, CAST(40 + k * 80 + 20 AS DOUBLE) AS ms, 40 + k * 80 + 20 <= 300 AS ok FROM generate_series(1, 8) g(k)",
    "limits_report": with_(UTT, pi.TOK, pi.sched("(1)"), pi.STATS) + """, p AS (SELECT conv_id, round(quantile_cont((least(e, n_chunks) - b) * 80, 0.99), 3) AS p99 FROM sc GROUP BY 1) SELECT st.conv_id, max_backlog, p99, max_backlog < 1 AND p99 < 80 AS ok FROM st JOIN p ON p.conv_id = st.conv_id""",
    "observable_at": with_(CONV, SEG, LEN, ps.PROB) + """, bl AS (SELECT *, min(p) OVER w AS lo, max(p) OVER w AS hi, max(f) OVER w AS last FROM pb WINDOW w AS (PARTITION BY conv_id, f // 13)), vv AS (SELECT conv_id, f, CASE WHEN f = last THEN hi ELSE lo END AS v FROM bl)
SELECT conv_id, count(*) FILTER (v > 900) AS n_over, CAST(sum(v * (f % 13 + 1)) AS BIGINT) AS check_sum FROM vv GROUP BY 1""",
    "infer_stitched": with_(CONV, SEG, LEN, ps.PROB) + """, ow AS (SELECT *, greatest(0, (f - 250) // 62) * 62 AS start, sum(p) OVER (PARTITION BY conv_id ORDER BY f ROWS UNBOUNDED PRECEDING) AS seen FROM pb)
SELECT a.conv_id, count(*) AS n, max(a.start) AS last_start, CAST(sum(a.seen - coalesce(b.seen, 0)) AS BIGINT) AS total FROM ow a LEFT JOIN ow b ON b.conv_id = a.conv_id AND b.f = a.start - 1 GROUP BY 1""",
    "speaker_pairs": f"SELECT {CORPUS.format('id')} AS corpus, count(DISTINCT (a, b)) AS pairs, count(*) AS n FROM (SELECT DISTINCT id, meta['spk1'] AS a, meta['spk2'] AS b FROM conversation WHERE id IS NOT NULL) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1",
    "languages": with_(CONV) + f"SELECT CASE {CORPUS.format('conv_id')} WHEN 'aihub' THEN 'Korean' WHEN 'oto' THEN 'English' WHEN 'tb' THEN 'English' ELSE 'unknown' END AS language, count(DISTINCT conv_id) AS n FROM conv GROUP BY 1",
    "fastest_utterances": with_(UTT, pi.TOK) + "SELECT utt.utt_id, round(count(*) * 1000 / greatest(any_value(e - s), 100), 6) AS rate FROM utt JOIN tok ON tok.utt_id = utt.utt_id GROUP BY 1 ORDER BY rate DESC, utt_id LIMIT 5",
    "token_weighted_rates": with_(UTT, pi.TOK) + """, r AS (SELECT count(*) AS n, sum(length(word)) AS chars, count(*) * 1000 / greatest(any_value(e - s), 100) AS r FROM utt JOIN tok ON tok.utt_id = utt.utt_id GROUP BY utt.utt_id)
SELECT CAST(sum(n) AS BIGINT) AS n, """ + ", ".join(f"round(sum(CASE WHEN r > {x} THEN n ELSE 0 END) / sum(n), 6) AS over_{k}" for k, x in enumerate((12.5, 25, 37.5, 50), 1)) + ", round(sum(chars) / sum(n), 6) AS chars_a_token FROM r",
    "latency_shares": with_(UTT, pi.TOK, pi.sched("(4)").replace("end_ms // 80 + 2", "end_ms // 80 + 0")) + "SELECT count(*) AS n, round(avg(CASE WHEN (e + 1) * 80 - end_ms < 0 THEN 1.0 ELSE 0.0 END), 6) AS before_end, round(avg(CASE WHEN (e + 1) * 80 - end_ms < -80 THEN 1.0 ELSE 0.0 END), 6) AS chunk_before, round(count(*) / (SELECT sum(n_chunks) FROM ln), 6) AS tokens_a_chunk FROM sc WHERE e < n_chunks",
    "swap_consistency": EVSQL + "SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_off FROM (SELECT DISTINCT conv_id, f, speaker, kind FROM ev)",
}
