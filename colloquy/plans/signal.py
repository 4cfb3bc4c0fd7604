"""Signals and feature vectors over the data set: each embedding stands for a frame of 64 samples, 50 to a conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.operators import signal as ops
from colloquy.operators.events import remove_short
from colloquy.plans.base import CONV, LEN, SEG, lengths, with_
from colloquy.tables import table


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """conv, f, vec, label."""
    e = table(spark, d, "embeddings").where("vec_id is not null and embedding is not null")
    return e.select(F.floor(F.col("vec_id") / 50).cast("bigint").alias("conv"), (F.col("vec_id") % 50).alias("f"), F.col("embedding").alias("vec"), "label")


def energy_db(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("conv", "f", F.round(ops.energy_db(F.col("vec")), 4).alias("db"))


def energy_vad(spark: SparkSession, d: str) -> DataFrame:
    """Active segments from energy, every other dozen of frames damped by 30 dB: hysteresis, short silences filled, short bursts dropped."""
    damped = energy_db(spark, d).select("conv", "f", (F.col("db") - 30 * (F.floor(F.col("f") / 12) % 2)).alias("db"))
    frames = ops.hysteresis(damped, ["conv"])
    w = Window.partitionBy("conv").orderBy("f")
    on = frames.where("on = 1").withColumn("k", F.col("f") - F.row_number().over(w))
    seg = on.groupBy("conv", "k").agg(F.min("f").alias("i"), (F.max("f") + 1).alias("j")).select(F.col("conv").alias("conv_id"), F.lit(0).alias("speaker"), "i", "j")
    n = frames.groupBy(F.col("conv").alias("conv_id")).agg((F.max("f") + 1).alias("t"))
    return remove_short(seg, n, 10, 5)


def channel_overlap_leak(spark: SparkSession, d: str) -> DataFrame:
    """Leak, correlation and overlap of two channels: vectors of even and odd stretches of 50, every other dozen of the first and every other eight of the second damped by 60 dB."""
    v = vectors(spark, d)
    damped = lambda n: F.transform("vec", lambda x: x.cast("double") / F.when(F.floor(F.col("f") / n) % 2 == 1, 1000).otherwise(1))
    side = lambda k, n, out: v.where(F.col("conv") % 2 == k).select(F.floor(F.col("conv") / 2).alias("conv"), "f", damped(n).alias(out))
    got = ops.channel_overlap_leak(side(0, 12, "a").join(side(1, 8, "b"), ["conv", "f"]), ["conv"])
    return got.select("conv", *(F.round(c, 4).alias(c) for c in ("leak", "corr", "overlap", "ratio_a", "ratio_b")))


def feature_pool_mean(spark: SparkSession, d: str) -> DataFrame:
    return ops.pool_mean(vectors(spark, d), ["conv"], 4).select("conv", "g", "pos", F.round("v", 5).alias("v"))


def feature_nearest(spark: SparkSession, d: str) -> DataFrame:
    x = ops.nearest_frames(vectors(spark, d), ["conv"], 50, 13)
    return x.select("conv", "i", "f", F.round(F.element_at("vec", 1).cast("double"), 5).alias("v0"))


def cosine_eval(spark: SparkSession, d: str) -> DataFrame:
    """Cosine and mean squared error between neighbouring frames, by label."""
    v = vectors(spark, d)
    x = v.join(v.select("conv", (F.col("f") - 1).alias("f"), F.col("vec").alias("vec2")), ["conv", "f"])
    mse = F.aggregate(F.zip_with("vec", "vec2", lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, y: s + y) / F.size("vec")
    return x.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(ops.cosine(F.col("vec"), F.col("vec2"))), 4).alias("cosine"), F.round(F.avg(mse), 4).alias("mse"))


def rank_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Rank of the labelled component among all: top-1 and top-5 shares and median rank, by label."""
    gold = F.element_at("vec", F.col("label") + 1)
    rank = F.size(F.filter("vec", lambda x: x > gold)) + 1
    x = vectors(spark, d).where("label is not null").select("label", rank.alias("r"))
    share = lambda k: F.round(F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)), 6)
    return x.groupBy("label").agg(F.count("*").alias("n"), share(1).alias("top1"), share(5).alias("top5"), F.round(F.percentile("r", F.lit(0.5)), 3).alias("median_rank"))


def lookahead_frames(spark: SparkSession, d: str) -> DataFrame:
    """How far ahead a centred mean of three frames looks: first frame that changes when all from frame 40 on are cut."""
    v = vectors(spark, d).select("conv", "f", F.element_at("vec", 1).cast("double").alias("x"))
    w = Window.partitionBy("conv").orderBy("f").rowsBetween(-1, 1)
    x = v.select("conv", "f", F.sum("x").over(w).alias("full"), F.sum(F.when(F.col("f") < 40, F.col("x")).otherwise(0.0)).over(w).alias("cut")).where("f < 40")
    return x.groupBy("conv").agg((40 - F.min(F.when(F.abs(F.col("full") - F.col("cut")) > 1e-9, F.col("f")))).alias("lookahead"))


def probabilities(spark: SparkSession, d: str) -> DataFrame:
    """A series of whole numbers below 1,000 for every 80 ms of every conversation: conv_id, n (how many), f, p."""
    n = lengths(spark, d).where("t >= 4").select("conv_id", F.floor(F.col("t") / 4).cast("bigint").alias("n"))
    x = n.select("conv_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("f"))
    return x.withColumn("p", (F.col("f") * 7919 + F.length("conv_id") * 104_729 + F.col("n") * 31) % 1000)


def infer_stitch_owner(spark: SparkSession, d: str) -> DataFrame:
    """Frames that each overlapping inference window (20 s, step 5 s) contributes: conv_id, owner, n, p."""
    owner = F.greatest(F.lit(0), F.floor((F.col("f") - 250) / 62)).cast("bigint")
    return probabilities(spark, d).groupBy("conv_id", owner.alias("owner")).agg(F.count("*").alias("n"), F.sum("p").alias("p"))


def lookahead_blocks(series: DataFrame, key: str, block: int) -> DataFrame:
    """key, f, v: within each block of frames the least value, at its last frame the greatest."""
    w = Window.partitionBy(key, F.floor(F.col("f") / block))
    return series.select(key, "f", F.when(F.col("f") == F.max("f").over(w), F.max("p").over(w)).otherwise(F.min("p").over(w)).alias("v"))


def lookahead_fold(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of 13 frames: every frame takes the block's minimum, the last its maximum; summed per conversation."""
    b = probabilities(spark, d).groupBy("conv_id", F.floor(F.col("f") / 13).alias("b")).agg(F.count("*").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    return b.groupBy("conv_id").agg(F.sum((F.col("n") - 1) * F.col("lo") + F.col("hi")).alias("total"), F.count("*").alias("blocks"))


VEC = "vec AS (SELECT vec_id // 50 AS conv, vec_id % 50 AS f, embedding AS vec, label FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)"
DB = "db AS (SELECT conv, f, round(10 * log10(list_sum(list_transform(vec, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / len(vec) + 1e-10), 4) AS db FROM vec)"
PROB = "pb AS (SELECT conv_id, n, f, (f * 7919 + length(conv_id) * 104729 + n * 31) % 1000 AS p FROM (SELECT conv_id, t // 4 AS n, unnest(generate_series(0, t // 4 - 1)) AS f FROM len WHERE t >= 4))"
QUERIES = {
    "energy_db": energy_db, "energy_vad": energy_vad, "channel_overlap_leak": channel_overlap_leak, "feature_pool_mean": feature_pool_mean, "feature_nearest": feature_nearest, "cosine_eval": cosine_eval, "rank_diagnostics": rank_diagnostics,
    "lookahead_frames": lookahead_frames, "infer_stitch_owner": infer_stitch_owner, "lookahead_fold": lookahead_fold,
}
SQL = {
    "energy_db": with_(VEC, DB) + "SELECT * FROM db",
    "energy_vad": with_(VEC, DB.replace("db AS (", "db0 AS ("), "db AS (SELECT conv, f, db - 30 * ((f // 12) % 2) AS db FROM db0)") + """, fl AS (SELECT conv, greatest(-40, quantile_cont(db, 0.1) + 12) AS up, greatest(-45, quantile_cont(db, 0.1) + 8) AS down FROM db GROUP BY 1),
h AS (SELECT db.conv, f, coalesce(last_value(CASE WHEN db > up THEN 1 WHEN db <= down THEN 0 END IGNORE NULLS) OVER (PARTITION BY db.conv ORDER BY f ROWS UNBOUNDED PRECEDING), 0) AS o FROM db JOIN fl ON fl.conv = db.conv),
r AS (SELECT conv, f, f - row_number() OVER (PARTITION BY conv ORDER BY f) AS k FROM h WHERE o = 1), sg AS (SELECT conv AS conv_id, 0 AS speaker, min(f) AS i, max(f) + 1 AS j FROM r GROUP BY conv, k),
ln AS (SELECT conv AS conv_id, max(f) + 1 AS t FROM db GROUP BY 1),
w AS (SELECT sg.*, t, lag(j) OVER p AS b, lead(i) OVER p AS a FROM sg JOIN ln ON ln.conv_id = sg.conv_id WINDOW p AS (PARTITION BY sg.conv_id ORDER BY i)),
k AS (SELECT *, sum(CASE WHEN b IS NOT NULL AND i - b < 10 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM w)
SELECT conv_id, speaker, i, j FROM (SELECT conv_id, speaker, run, min(CASE WHEN b IS NULL AND i < 10 THEN 0 ELSE i END) AS i, max(CASE WHEN a IS NULL AND t - j < 10 THEN greatest(t, j) ELSE j END) AS j FROM k GROUP BY 1, 2, 3) WHERE j - i >= 5""",
    "feature_pool_mean": with_(VEC) + "SELECT conv, g, CAST(pos AS INT) AS pos, round(avg(v), 5) AS v FROM (SELECT conv, f // 4 AS g, unnest(generate_series(0, len(vec) - 1)) AS pos, unnest(list_transform(vec, lambda x: CAST(x AS DOUBLE))) AS v FROM vec) GROUP BY 1, 2, 3 HAVING count(*) = 4",
    "feature_nearest": with_(VEC) + """, o AS (SELECT conv, top, CAST(unnest(generate_series(0, CAST(floor((top + 1) / (50 / 13)) AS BIGINT) - 1)) AS INT) AS i FROM (SELECT conv, max(f) AS top FROM vec GROUP BY 1))
SELECT o.conv, i, vec.f, round(CAST(vec[1] AS DOUBLE), 5) AS v0 FROM o JOIN vec ON vec.conv = o.conv AND vec.f = least(CAST(floor(i * (50 / 13) + (50 / 13) / 2) AS BIGINT), top)""",
    "cosine_eval": with_(VEC) + """SELECT a.label, count(*) AS n, round(avg(list_cosine_similarity(CAST(a.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[]))), 4) AS cosine, round(avg(pow(list_distance(CAST(a.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[])), 2) / len(a.vec)), 4) AS mse
FROM vec a JOIN vec b ON a.conv = b.conv AND b.f = a.f + 1 GROUP BY 1""",
    "rank_diagnostics": with_(VEC) + """, r AS (SELECT label, len(list_filter(vec, lambda x: x > vec[label + 1])) + 1 AS r FROM vec WHERE label IS NOT NULL)
SELECT label, count(*) AS n, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 6) AS top5, round(quantile_cont(r, 0.5), 3) AS median_rank FROM r GROUP BY 1""",
    "lookahead_frames": with_(VEC) + """, w AS (SELECT conv, f, sum(CAST(vec[1] AS DOUBLE)) OVER p AS full_, sum(CASE WHEN f < 40 THEN CAST(vec[1] AS DOUBLE) ELSE 0 END) OVER p AS cut FROM vec WINDOW p AS (PARTITION BY conv ORDER BY f ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT conv, 40 - min(CASE WHEN abs(full_ - cut) > 1e-9 THEN f END) AS lookahead FROM w WHERE f < 40 GROUP BY 1""",
    "infer_stitch_owner": with_(CONV, SEG, LEN, PROB) + "SELECT conv_id, greatest(0, CAST(floor((f - 250) / 62) AS BIGINT)) AS owner, count(*) AS n, CAST(sum(p) AS BIGINT) AS p FROM pb GROUP BY 1, 2",
    "lookahead_fold": with_(CONV, SEG, LEN, PROB) + "SELECT conv_id, CAST(sum((n - 1) * lo + hi) AS BIGINT) AS total, count(*) AS blocks FROM (SELECT conv_id, f // 13 AS b, count(*) AS n, min(p) AS lo, max(p) AS hi FROM pb GROUP BY 1, 2) GROUP BY 1",
}
