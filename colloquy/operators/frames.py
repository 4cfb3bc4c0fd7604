"""Frame-rate conversion and frame labels.

Segments become frames only inside a task, as the few chunks each of them touches, or inside an Arrow kernel
over one stretch of time; silent frames are never rows unless a label of silence is asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.schema import future_bins

SHARD = 7_500  # frames of a stretch of time: ten minutes at 12.5 Hz


def chunk_cover(seg: DataFrame, factor: int) -> DataFrame:
    """Active source frames of every chunk of ``factor`` frames that is touched: conv_id, speaker, chunk, n."""
    c = F.col("chunk")
    x = seg.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("i") / factor), F.floor((F.col("j") - 1) / factor))))
    part = F.least("j", (c + 1) * factor) - F.greatest("i", c * factor)
    return x.groupBy("conv_id", "speaker", "chunk").agg(F.sum(part).alias("n"))


def pool(seg: DataFrame, length: DataFrame, factor: int, mode: str = "any") -> DataFrame:
    """Active chunks (conv_id, speaker, chunk) by any frame or by the majority (at least half); an incomplete last chunk is dropped."""
    cover = chunk_cover(seg, factor).join(length, "conv_id").where(F.col("chunk") < F.floor(F.col("t") / factor))
    return cover.where(F.col("n") >= 1 if mode == "any" else F.col("n") * 2 >= factor).select("conv_id", "speaker", "chunk")


def resample_any(seg: DataFrame, length: DataFrame, hz: int, src_hz: int = 50) -> DataFrame:
    """Active output frames (conv_id, speaker, k) at another rate; frame k is active if any source frame from round(k/hz*src) up to round((k+1)/hz*src) is, or the one at the start if that is none.

    Output frames 0 <= k < round(t * hz / src_hz); beyond the source they are silent.
    """
    edge = lambda k: F.bround(k * src_hz / F.lit(hz)).cast("bigint")
    k = F.col("k")
    lo, hi = F.floor(F.col("i") * hz / src_hz) - 2, F.ceil(F.col("j") * hz / src_hz) + 2
    x = seg.join(length, "conv_id").withColumn("k", F.explode(F.sequence(F.greatest(lo, F.lit(0)).cast("bigint"), hi.cast("bigint"))))
    a, b = edge(k), edge(k + 1)
    b = F.when(b > a, b).otherwise(F.least(a, F.col("t") - 1) + 1)
    a = F.least(a, b - 1)
    n_out = F.bround(F.col("t") * hz / src_hz)
    return x.where((a < F.col("j")) & (b > F.col("i")) & (k < n_out)).select("conv_id", "speaker", "k").distinct()


def _labels_of_shards(seg: DataFrame, length: DataFrame, hz: float, counted: bool) -> DataFrame:
    """Labels by an Arrow kernel over conversation and stretch of time; each stretch has the activity of its horizon besides its own."""
    bins = future_bins(hz)
    horizon = sum(bins)
    spine = length.where(F.col("n") > horizon).select("conv_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - horizon - 1) / SHARD))).alias("shard"))
    spine = spine.select("conv_id", "shard", "n", F.lit(-1).alias("speaker"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    lo, hi = F.greatest(F.floor((F.col("a") - horizon) / SHARD), F.lit(0)), F.floor((F.col("b") - 1) / SHARD)
    cut = seg.where("b > a").select("conv_id", F.explode(F.sequence(lo, hi)).alias("shard"), F.lit(0).cast("bigint").alias("n"), F.col("speaker").cast("int").alias("speaker"), F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))

    def label(key: tuple, rows: pa.Table) -> pa.Table:
        conv, first = key[0].as_py(), key[1].as_py() * SHARD
        n, speaker, a, b = (np.asarray(rows.column(k)).astype(np.int64) for k in ("n", "speaker", "a", "b"))
        size = min(first + SHARD, int(n.max()) - horizon) - first
        label = np.zeros(max(size, 0), np.int32)
        for s in (0, 1) if size > 0 else ():
            edge = np.zeros(size + horizon + 2, np.int32)
            mine = speaker == s
            np.add.at(edge, np.clip(a[mine] - first, 0, size + horizon + 1), 1)
            np.add.at(edge, np.clip(b[mine] - first, 0, size + horizon + 1), -1)
            total = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
            at = 1
            for k, width in enumerate(bins):
                label |= (2 * (total[at + width : at + width + size] - total[at : at + size]) >= width).astype(np.int32) << (4 * s + k)
                at += width
        if counted:
            values, times = np.unique(label, return_counts=True)
            return pa.table({"conv_id": pa.array([conv] * len(values), pa.string()), "label": values.astype(np.int32), "n": times.astype(np.int64)})
        return pa.table({"conv_id": pa.array([conv] * len(label), pa.string()), "f": np.arange(first, first + len(label)), "label": label})

    kind = "conv_id string, label int, n bigint" if counted else "conv_id string, f bigint, label int"
    return spine.unionByName(cut).groupBy("conv_id", "shard").applyInArrow(label, kind)


def future_labels(active: DataFrame, length: DataFrame, hz: float) -> DataFrame:
    """Class of future activity of each frame: conv_id, f, label (0-255).

    ``active``: conv_id, speaker, chunk of active frames; ``length``: conv_id, ``n`` frames. Each speaker has
    four bits, one per future bin, set if at least half of the bin is active; speaker 0
    has the low ones. Frames whose horizon ends beyond the conversation have no label.
    """
    return _labels_of_shards(active.select("conv_id", "speaker", F.col("chunk").alias("a"), (F.col("chunk") + 1).alias("b")), length, hz, False)


def future_label_counts(seg: DataFrame, length: DataFrame, hz: float, factor: int) -> DataFrame:
    """How many frames of each class: conv_id, label, n. ``seg``: segments in source frames, of which ``factor`` make one (active if any is); ``length``: conv_id, ``n`` frames. No frame leaves the kernel."""
    whole = seg.select("conv_id", "speaker", F.floor(F.col("i") / factor).alias("a"), (F.floor((F.col("j") - 1) / factor) + 1).alias("b"))
    within = whole.join(length, "conv_id").select("conv_id", "speaker", "a", F.least("b", "n").alias("b"))
    return _labels_of_shards(within, length, hz, True).groupBy("conv_id", "label").agg(F.sum("n").alias("n"))
