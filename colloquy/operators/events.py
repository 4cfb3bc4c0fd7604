"""Turn events, onsets and labels derived from merged activity segments.

Segments are maximal runs [i, j) of frames per (conv_id, speaker). Nothing is expanded to
frames: what lies ahead of or around a segment's edge is looked up in one sort per speaker and stretch of time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARD = 30_000  # frames of a stretch of time: ten minutes at 50 Hz


def turn_events(seg: DataFrame, length: DataFrame, hz: float = 50, pause_s: float = 0.2, window_s: float = 3.0, bc_max_s: float = 1.0, overlap_s: float = 0.5, resume_s: float = 1.0) -> DataFrame:
    """SHIFT, HOLD, INTERRUPT and BACKCHANNEL events: conv_id, f, speaker, kind.

    SHIFT and HOLD belong to the speaker who stopped, INTERRUPT and BACKCHANNEL to the
    one who came in. ``length``: conv_id and its number of frames ``t``. A tie between
    both speakers' next starts is a HOLD.
    """
    p, w, bc, ot, rs = (int(x * hz) for x in (pause_s, window_s, bc_max_s, overlap_s, resume_s))
    i, j, ns = F.col("i"), F.col("j"), F.col("ns")
    own = seg.join(length, "conv_id").withColumn("ns", F.lead("i").over(Window.partitionBy("conv_id", "speaker").orderBy("i")))
    # One list per speaker and stretch of time: the other speaker's segments in every stretch from which they can be seen, this
    # one's starts and ends. At equal times an end comes before the other's start, a start after it.
    nothing = F.lit(None).cast("bigint")
    row = lambda speaker, shard, at, rank, oj, onext, keep: F.struct(
        speaker.alias("speaker"), shard.cast("bigint").alias("shard"), at.alias("at"), F.lit(rank).alias("rank"), oj.alias("oj"), onext.alias("onext"), *((F.col(c) if keep else nothing).alias(c) for c in ("i", "j", "ns", "t"))
    )
    shards = F.sequence(F.greatest(F.floor((i - w) / SHARD), F.lit(0)), F.floor(j / SHARD))
    seen = F.transform(shards, lambda k: row(1 - F.col("speaker"), k, i, 1, j, ns, False))
    asked = F.array(row(F.col("speaker"), F.floor(j / SHARD), j, 0, nothing, nothing, True), row(F.col("speaker"), F.floor(i / SHARD), i, 2, nothing, nothing, True))
    x = own.select("conv_id", F.explode(F.concat(seen, asked)).alias("x")).select("conv_id", "x.*")
    here = Window.partitionBy("conv_id", "speaker", "shard")
    before = F.last(F.when(F.col("rank") == 1, F.struct("oj", "onext")), ignorenulls=True).over(here.orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, 0))
    first = F.min(F.when(F.col("rank") == 1, F.col("at"))).over(here)
    x = x.withColumns({"o": before, "first": first}).where("rank <> 1")
    oe = F.col("o.oj")
    next_o = F.when(F.col("o").isNull(), F.col("first")).otherwise(F.col("o.onext"))
    ends = (j + p <= F.col("t")) & (ns.isNull() | (ns - j >= p)) & ~F.coalesce(oe >= j, F.lit(False))
    soon = F.coalesce(next_o < j + w, F.lit(False))
    own_later = ns.isNull() | (ns >= j + w) | (next_o < ns)
    end_event = F.when(ends, F.struct(j.alias("f"), F.col("speaker").alias("speaker"), F.when(soon & own_later, "SHIFT").otherwise("HOLD").alias("kind")))
    resumes = F.coalesce(F.col("o.onext") < oe + rs, F.lit(False))
    outlasts = (j > oe) & ~resumes
    start_event = F.when(
        (i > 0) & F.coalesce(oe > i, F.lit(False)),
        F.when((oe - i <= ot) & outlasts, F.struct(oe.alias("f"), (1 - F.col("speaker")).alias("speaker"), F.lit("SHIFT").alias("kind")))
        .when(outlasts, F.struct(i.alias("f"), F.col("speaker").alias("speaker"), F.lit("INTERRUPT").alias("kind")))
        .when(j - i <= bc, F.struct(i.alias("f"), F.col("speaker").alias("speaker"), F.lit("BACKCHANNEL").alias("kind"))),
    )
    event = F.when(F.col("rank") == 0, end_event).otherwise(start_event)
    return x.select("conv_id", event.alias("ev")).where("ev is not null").select("conv_id", "ev.*")


def onsets(seg: DataFrame, min_gap: int) -> DataFrame:
    """Segments that begin after at least ``min_gap`` frames of own silence (or first): conv_id, speaker, i."""
    before = F.lag("j").over(Window.partitionBy("conv_id", "speaker").orderBy("i"))
    return seg.withColumn("before", before).where("before is null or before <= i - %d" % min_gap).select("conv_id", "speaker", "i")


def onset_bin_counts(onset: DataFrame, length: DataFrame, edges: list[float], horizon: int) -> DataFrame:
    """Frames by time to the next onset: conv_id, speaker, bin, censored, n.

    For frame t the next onset is the first strictly after t; its bin is the number of ``edges``
    not above the distance; a distance over ``horizon`` (or no onset) is censored and falls into the
    last bin. Counted per stretch between onsets, without expanding frames.
    """
    w = Window.partitionBy("conv_id", "speaker").orderBy("i")
    both = length.select("conv_id", "t", F.explode(F.array(F.lit(0), F.lit(1))).alias("speaker"))
    ahead = onset.select("conv_id", "speaker", "i", F.coalesce(F.lag("i").over(w), F.lit(0)).alias("since")).where("i > since")
    last = both.join(onset.groupBy("conv_id", "speaker").agg(F.max("i").alias("last")), ["conv_id", "speaker"], "left")
    tail = last.select("conv_id", "speaker", F.lit(len(edges)).alias("bin"), F.lit(True).alias("censored"), (F.col("t") - F.coalesce("last", F.lit(0))).alias("n")).where("n > 0")
    ahead = ahead.join(length, "conv_id").select("conv_id", "speaker", (F.col("i") - F.col("since")).alias("d"), (F.col("i") - F.least("i", "t")).alias("skip"))
    # distances skip+1 .. d occur once each; bin b has those from ceil(edge b) on
    lows = [1, *(int(-(-e // 1)) for e in edges)]
    highs = [*(lo - 1 for lo in lows[1:]), horizon]
    parts = [F.struct(F.lit(b).alias("bin"), F.lit(False).alias("censored"), F.greatest(F.least("d", F.lit(hi)) - F.greatest(F.col("skip"), F.lit(lo - 1)), F.lit(0)).alias("n")) for b, (lo, hi) in enumerate(zip(lows, highs, strict=True))]
    parts.append(F.struct(F.lit(len(edges)).alias("bin"), F.lit(True).alias("censored"), F.greatest(F.col("d") - F.greatest(F.col("skip"), F.lit(horizon)), F.lit(0)).alias("n")))
    counted = ahead.select("conv_id", "speaker", F.explode(F.array(*parts)).alias("p")).select("conv_id", "speaker", "p.*")
    return counted.unionByName(tail).where("n > 0").groupBy("conv_id", "speaker", "bin", "censored").agg(F.sum("n").alias("n"))


def quality_flags(seg: DataFrame, length: DataFrame, events: DataFrame, hz: float = 50, min_ratio: float = 0.05, min_s: float = 30) -> DataFrame:
    """conv_id, flag: one_channel_silent, too_short or no_events."""
    both = length.select("conv_id", "t", F.explode(F.array(F.lit(0), F.lit(1))).alias("speaker"))
    active = seg.groupBy("conv_id", "speaker").agg(F.sum(F.col("j") - F.col("i")).alias("n"))
    ratio = both.join(active, ["conv_id", "speaker"], "left").groupBy("conv_id").agg(F.min(F.coalesce("n", F.lit(0)) / F.greatest("t", F.lit(1))).alias("least"), F.first("t").alias("t"))
    some = events.select("conv_id", F.lit(1).alias("some")).distinct()
    flags = F.array_compact(F.array(F.when(F.col("least") < min_ratio, "one_channel_silent"), F.when(F.col("t") < min_s * hz, "too_short"), F.when(F.col("some").isNull(), "no_events")))
    return ratio.join(some, "conv_id", "left").select("conv_id", F.explode(flags).alias("flag"))


def remove_short(seg: DataFrame, length: DataFrame, min_silence: int, min_speech: int) -> DataFrame:
    """Silence shorter than ``min_silence`` becomes speech (also at either end), then speech shorter than ``min_speech`` silence."""
    w = Window.partitionBy("conv_id", "speaker").orderBy("i")
    x = seg.join(length, "conv_id").withColumns({"before": F.lag("j").over(w), "after": F.lead("i").over(w)})
    x = x.withColumn("new", F.when(F.col("before").isNotNull() & (F.col("i") - F.col("before") < min_silence), 0).otherwise(1))
    x = x.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    i = F.when(F.col("before").isNull() & (F.col("i") < min_silence), 0).otherwise(F.col("i"))
    j = F.when(F.col("after").isNull() & (F.col("t") - F.col("j") < min_silence), F.greatest("t", "j")).otherwise(F.col("j"))
    joined = x.withColumns({"i2": i, "j2": j}).groupBy("conv_id", "speaker", "run").agg(F.min("i2").alias("i"), F.max("j2").alias("j"))
    return joined.where(F.col("j") - F.col("i") >= min_speech).select("conv_id", "speaker", "i", "j")
