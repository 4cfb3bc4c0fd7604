"""Training examples: windows with their labels, features and token streams, as rows of arrays.

What lies in a window is brought to it by window number, so that an example is made from the few rows it
holds; labels are then made by one Arrow kernel over rows that are bounded by the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.schema import future_bins, onset_edges

DELAYS = (2, 3, 4, 6)
# Control tokens of the interleaved stream.
SPECIALS = ("<NEXT_AUDIO>", "<EMPTY_AUDIO>", "<SPK_A>", "<SPK_B>", *(f"<DELAY_{d}>" for d in range(1, 9)))
IGNORED = -100


def shuffled(key: Column, salt: int = 7919) -> Column:
    """A place in an arithmetic order that is the same on every run; ties go by whatever follows it in a sort."""
    return F.pmod(key * salt, F.lit(100_003))


def capped(rows: DataFrame, order: list[Column], cap: int | None) -> DataFrame:
    """The first ``cap`` rows of a seeded order (all without a cap); the cap is a parameter, so the rows are few."""
    return rows if cap is None else rows.orderBy(*order).limit(cap)


def carve_out(ids: DataFrame, key: str, number: Column, fraction: float, cap: int) -> DataFrame:
    """``split``: val for min(cap, max(1, n * fraction)) ids, taken in a seeded order, else train; no ids give no rows."""
    names = ids.select(F.col(key), number.alias("__n")).distinct()
    n = names.count()
    val = names.orderBy(shuffled(F.col("__n")), key).limit(min(cap, max(1, int(n * fraction)))).select(key)
    return names.join(val.withColumn("__val", F.lit(True)), key, "left").select(key, F.when(F.col("__val"), "val").otherwise("train").alias("split"))


def in_windows(rows: DataFrame, lo: Column, hi: Column, window: int, hop: int) -> DataFrame:
    """Add ``win``: every window [win * hop, win * hop + window) that [lo, hi) reaches into."""
    first = F.greatest(F.floor((lo - window) / hop) + 1, F.lit(0))
    return rows.where((hi > lo) & (hi > 0)).withColumn("win", F.explode(F.sequence(first.cast("int"), F.greatest(F.floor((hi - 1) / hop), first).cast("int")))).where((F.col("win") * hop < hi) & (F.col("win") * hop + window > lo))


def windowed_segments(windows: DataFrame, seg: DataFrame, window: int, hop: int) -> DataFrame:
    """Windows (conv_id, win, start) with their activity: ``segs``, an array of (speaker, a, b) counted from the window's start and cut at its ends. A window without activity has an empty one."""
    placed = in_windows(seg, F.col("i"), F.col("j"), window, hop)
    start = F.col("win").cast("bigint") * hop
    cut = placed.select("conv_id", "win", F.struct(F.col("speaker").cast("int").alias("speaker"), F.greatest(F.col("i") - start, F.lit(0)).cast("int").alias("a"), F.least(F.col("j") - start, F.lit(window)).cast("int").alias("b")).alias("x"))
    lists = cut.groupBy("conv_id", "win").agg(F.collect_list("x").alias("segs"))
    return windows.join(lists, ["conv_id", "win"], "left").withColumn("segs", F.coalesce("segs", F.array().cast("array<struct<speaker:int,a:int,b:int>>")))


def _activity(segs: pa.Array, n: int) -> np.ndarray:
    """Activity (row x frame x speaker) of a column of segment lists."""
    rows = np.repeat(np.arange(len(segs)), np.asarray(segs.value_lengths().fill_null(0)))
    speaker, a, b = (np.asarray(segs.flatten().field(k)).astype(np.int64) for k in range(3))
    edges = np.zeros((len(segs), n + 1, 2), np.int16)
    np.add.at(edges, (rows, a, speaker), 1)
    np.add.at(edges, (rows, b, speaker), -1)
    return (np.cumsum(edges[:, :-1], axis=1, dtype=np.int16) > 0).astype(np.int8)


def _sums(on: np.ndarray) -> np.ndarray:
    """Running totals along the frames, with a nought in front."""
    return np.concatenate([np.zeros((len(on), 1, 2), np.int32), np.cumsum(on, axis=1, dtype=np.int32)], axis=1)


def _labels(on: np.ndarray, hz: float) -> np.ndarray:
    """Class of future activity of each frame that has its horizon in the window, IGNORED for the rest."""
    bins = future_bins(hz)
    out = np.full(on.shape[:2], IGNORED, np.int32)
    n = on.shape[1] - sum(bins)
    if n <= 0:
        return out
    total = _sums(on)
    out[:, :n] = 0
    at = 1
    for k, width in enumerate(bins):
        hit = 2 * (total[:, at + width : at + width + n] - total[:, at : at + n]) >= width
        out[:, :n] |= hit[:, :, 0].astype(np.int32) << k | hit[:, :, 1].astype(np.int32) << (4 + k)
        at += width
    return out


def _onset_bins(on: np.ndarray, hz: float) -> tuple[np.ndarray, np.ndarray]:
    """Bin of the time to the next onset within the window, per frame and speaker, and whether there is none within the horizon. Speech at the first frame is an onset there."""
    n, gap, horizon, never = on.shape[1], int(0.2 * hz), round(2.56 * hz), np.iinfo(np.int32).max // 2
    before = np.concatenate([np.zeros_like(on[:, :1]), on[:, :-1]], axis=1)
    total, frames = _sums(on), np.arange(n)
    quiet = total[:, frames] == total[:, np.maximum(frames - gap, 0)]
    at = np.where((on == 1) & (before == 0) & quiet, frames[None, :, None], never).astype(np.int32)
    ahead = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1]
    tau = np.concatenate([ahead[:, 1:], np.full_like(ahead[:, :1], never)], axis=1) - frames[None, :, None]
    censored = tau > horizon
    bins = np.digitize(tau, onset_edges(hz)).astype(np.int8)
    bins[censored] = len(onset_edges(hz))
    return bins, censored


def _nested(x: np.ndarray) -> pa.Array:
    """An array of any number of axes as lists of lists."""
    out = pa.array(x.reshape(-1))
    for size in x.shape[:0:-1]:
        out = pa.ListArray.from_arrays(pa.array(np.arange(len(out) // size + 1, dtype=np.int32) * size), out)
    return out


EXAMPLE = "vad array<array<tinyint>>, label array<int>, tau_bin array<array<tinyint>>, censored array<array<boolean>>"


def materialized(windows: DataFrame, keys: list[str], window: int, hz: float, src_hz: int = 50) -> DataFrame:
    """Windows with ``segs`` -> keys, vad (frame x speaker), label, tau_bin, censored, all made within the window.

    The frame rate divides ``src_hz``; a frame is active if any of its source frames is.
    """
    factor = round(src_hz / hz)
    kept = windows.select(*keys, "segs")
    head = ", ".join(f"{k} {kept.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            frames = window // factor
            vad = _activity(b.column(len(keys)), window)[:, : frames * factor].reshape(b.num_rows, frames, factor, 2).max(2)
            columns = [_nested(x) for x in (vad, _labels(vad, hz), *_onset_bins(vad, hz))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), *columns], [*keys, "vad", "label", "tau_bin", "censored"])

    return kept.mapInArrow(run, f"{head}, {EXAMPLE}")


def example_totals(examples: DataFrame, keys: list[str]) -> DataFrame:
    """What examples hold: keys, n_a and n_b active frames, n_labels, label_sum (labels times their place, from 1), bin_sum, n_censored."""
    head = ", ".join(f"{k} {examples.schema[k].dataType.simpleString()}" for k in keys)
    names = ("n_a", "n_b", "n_labels", "label_sum", "bin_sum", "n_censored")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column(len(keys) + 1)
            frames = np.asarray(label.value_lengths()).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), frames)
            flat = lambda k: np.asarray(b.column(len(keys) + k).flatten().flatten()).astype(np.int64).reshape(-1, 2)
            total = lambda v: np.bincount(row, weights=v, minlength=b.num_rows).astype(np.int64)
            y = np.asarray(label.flatten()).astype(np.int64)
            place = np.arange(len(y)) - np.repeat(np.cumsum(frames) - frames, frames) + 1
            vad, ok = flat(0), y >= 0
            out = (total(vad[:, 0]), total(vad[:, 1]), total(ok), total(np.where(ok, y * place, 0)), total(flat(2).sum(1)), total(flat(3).sum(1)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), *map(pa.array, out)], [*keys, *names])

    return examples.select(*keys, "vad", "label", "tau_bin", "censored").mapInArrow(run, head + ", " + ", ".join(f"{n} bigint" for n in names))


def resampled_activity(on: np.ndarray, hz: float, n_out: int, src_hz: float = 50) -> np.ndarray:
    """Activity at another rate: an output frame is active if any source frame it covers is (the one at its start if it covers none); beyond the source it is silent."""
    edges = np.clip(np.round(np.arange(n_out + 1) / hz * src_hz).astype(int), 0, len(on))
    out = np.zeros((n_out, 2), np.int8)
    total = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(on, axis=0, dtype=np.int64)])
    a, b = edges[:-1], edges[1:]
    some = b > a
    out[some] = total[b[some]] > total[a[some]]
    if len(on):
        out[~some] = on[np.minimum(a[~some], len(on) - 1)]
    return out


def probe_examples(windows: DataFrame, keys: list[str], window: int, hz: float) -> DataFrame:
    """Windows with ``segs`` (50 Hz) and ``feats`` (frames at ``hz``) -> keys, feats, vad and label of as many frames as there are features."""
    kept = windows.select(*keys, "segs", "feats")
    head = ", ".join(f"{k} {kept.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.asarray(b.column(len(keys) + 1).value_lengths().fill_null(0))
            vads, labels = [], []
            for on, n in zip(_activity(b.column(len(keys)), window), lengths, strict=True):
                on = resampled_activity(on, hz, int(n))
                vads.append(on.tolist())
                labels.append(_labels(on[None], hz)[0].tolist())
            columns = [pa.array(vads, pa.list_(pa.list_(pa.int8()))), pa.array(labels, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), b.column(len(keys) + 1), *columns], [*keys, "feats", "vad", "label"])

    return kept.mapInArrow(run, f"{head}, feats {kept.schema['feats'].dataType.simpleString()}, vad array<array<tinyint>>, label array<int>")


def feature_slices(spans: DataFrame, features: DataFrame, key: str, by: str, pad_to: int | None = None, zero: Column | None = None) -> DataFrame:
    """Spans (key, by, a, b) with ``feats``, the feature frames (by, f, vec) a <= f < b in order, padded with ``zero`` to ``pad_to`` frames.

    Frames meet spans by cells of 256 frames, so a long recording is many tasks. A span without frames has an empty list (or only padding).
    """
    cell = 256
    asked = spans.select(key, by, "a", "b").where("b > a").withColumn("c", F.explode(F.sequence(F.floor(F.col("a") / cell), F.floor((F.col("b") - 1) / cell))))
    held = features.select(by, "f", "vec").withColumn("c", F.floor(F.col("f") / cell))
    met = asked.join(held, [by, "c"]).where("f >= a and f < b").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "vec"))), lambda x: x["vec"]).alias("feats"))
    out = spans.join(met, key, "left").withColumn("feats", F.coalesce("feats", F.array().cast(met.schema["feats"].dataType)))
    if pad_to is None:
        return out
    return out.withColumn("feats", F.concat("feats", F.array_repeat(zero, F.greatest(F.lit(pad_to) - F.size("feats"), F.lit(0)))))


def nearest_resampled(feats: Column, src_hz: float, dst_hz: float) -> Column:
    """An array of frames at another rate: the mean of each group for whole divisors is left to pool_mean; here frame int(i * r + r / 2), r = src / dst, floor(T / r) of them."""
    r = src_hz / dst_hz
    n = F.floor(F.size(feats) / F.lit(r)).cast("int")
    at = lambda i: F.least(F.floor(i * F.lit(r) + F.lit(r / 2)).cast("int"), F.size(feats) - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(feats, at(i) + 1))).otherwise(F.slice(feats, 1, 0))


def with_prefix(sequence: DataFrame, keys: DataFrame, key: str, prefix: Column) -> DataFrame:
    """Items of sequences (key, pos, kind, label) behind a prefix of token ids, whose labels are ignored; ``keys`` has one row a sequence and the columns of ``prefix``."""
    head = keys.select(key, F.posexplode(prefix).alias("pos", "id")).select(key, "pos", F.lit("prefix").alias("kind"), F.lit(IGNORED).cast("bigint").alias("label"))
    size = keys.select(key, F.size(prefix).alias("__k"))
    rest = sequence.join(size, key).select(key, (F.col("pos") + F.col("__k")).alias("pos"), "kind", "label")
    return head.unionByName(rest.withColumn("pos", F.col("pos").cast("int")))
