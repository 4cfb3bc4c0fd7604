"""Energy, voice activity from samples, and vectors of features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def energy_db(block: Column) -> Column:
    """10 * log10(mean of squares + 1e-10) of a block of samples."""
    total = F.aggregate(block, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return 10 * F.log10(total / F.size(block) + F.lit(1e-10))


def hysteresis(frames: DataFrame, keys: list[str], on_floor: float = -40, off_floor: float = -45) -> DataFrame:
    """Add ``on``: speech begins above the upper threshold and goes on while above the lower one.

    ``frames``: keys, f, db. Thresholds adapt to the 10th percentile of the key (+12 and +8 dB) but never fall below the floors.
    """
    low = frames.groupBy(*keys).agg(F.percentile("db", F.lit(0.1)).alias("floor"))
    x = frames.join(low, keys)
    up, down = F.greatest(F.lit(on_floor), F.col("floor") + 12), F.greatest(F.lit(off_floor), F.col("floor") + 8)
    state = F.when(F.col("db") > up, 1).when(F.col("db") <= down, 0)
    w = Window.partitionBy(*keys).orderBy("f").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("on", F.coalesce(F.last(state, ignorenulls=True).over(w), F.lit(0))).drop("floor")


def channel_overlap_leak(frames: DataFrame, keys: list[str], on_db: float = -40, first: int = 3000, least: int = 10) -> DataFrame:
    """How well two channels are kept apart: keys, leak, corr, overlap, ratio_a, ratio_b.

    ``frames``: keys, f, a, b, the blocks of samples of either channel. leak: mean of b's less a's dB where only a is active, null
    unless that are more than ``least`` frames; corr: of the samples of the ``first`` frames (60 s of 20 ms), null if a channel never changes; overlap: frames with
    both active over frames with any.
    """
    x = frames.withColumns({"da": energy_db(F.col("a")), "db": energy_db(F.col("b"))}).withColumns({"va": F.col("da") > on_db, "vb": F.col("db") > on_db})
    only_a, share = F.col("va") & ~F.col("vb"), lambda c: F.avg(F.col(c).cast("int"))
    leak = F.when(F.count_if(only_a) > least, F.avg(F.when(only_a, F.col("db") - F.col("da"))))
    overlap = F.count_if(F.col("va") & F.col("vb")) / F.greatest(F.lit(1), F.count_if(F.col("va") | F.col("vb")))
    each = x.groupBy(*keys).agg(leak.alias("leak"), overlap.alias("overlap"), share("va").alias("ratio_a"), share("vb").alias("ratio_b"))
    samples = frames.where(F.col("f") < first).select(*keys, F.explode(F.arrays_zip("a", "b")).alias("s")).select(*keys, F.col("s.a").cast("double").alias("a"), F.col("s.b").cast("double").alias("b"))
    return each.join(samples.groupBy(*keys).agg((F.covar_pop("a", "b") / F.nullif(F.stddev_pop("a") * F.stddev_pop("b"), F.lit(0.0))).alias("corr")), keys, "left").select(*keys, "leak", "corr", "overlap", "ratio_a", "ratio_b")


def pool_mean(vectors: DataFrame, keys: list[str], factor: int) -> DataFrame:
    """Mean vector of each ``factor`` frames (keys, g, pos, v); an incomplete last group is dropped."""
    x = vectors.select(*keys, F.floor(F.col("f") / factor).cast("bigint").alias("g"), F.posexplode("vec").alias("pos", "v"))
    return x.groupBy(*keys, "g", "pos").agg(F.count("*").alias("n"), F.avg("v").alias("v")).where(F.col("n") == factor).drop("n")


def nearest_frames(vectors: DataFrame, keys: list[str], src_hz: float, dst_hz: float) -> DataFrame:
    """Frames at another rate: output frame i is input frame int(i * r + r / 2), r = src / dst; floor(T / r) of them."""
    r = src_hz / dst_hz
    n = vectors.groupBy(*keys).agg(F.max("f").alias("top"))
    out = n.withColumn("n", F.floor((F.col("top") + 1) / r).cast("int")).where("n > 0").select(*keys, "top", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    src = out.select(*keys, "i", F.least(F.floor(F.col("i") * r + r / 2).cast("bigint"), F.col("top")).alias("f"))
    return src.join(vectors, [*keys, "f"])


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def mel_filters(sr: int, n_fft: int, n_mels: int) -> np.ndarray:
    """Triangular filters evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(sr / 2), n_mels + 2) / 2595) - 1)
    freq = np.linspace(0, sr / 2, n_fft // 2 + 1)
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((freq - lo) / (mid - lo), (hi - freq) / (hi - mid)))


def log_mel(audio: DataFrame, key: str, samples: str, sr: int = 16_000, n_mels: int = 80, n_fft: int = 1024, win: int = 400, hop: int = 320) -> DataFrame:
    """Log mel energies at sr / hop frames a second: key, f, mel (array of float). An Arrow kernel over whole signals."""
    bank, window = mel_filters(sr, n_fft, n_mels), np.hanning(win + 1)[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, x in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                x = np.pad(np.asarray(x or [], np.float64), (0, win))
                n = max(0, (len(x) - win) // hop)
                if not n:
                    continue
                at = np.arange(n)[:, None] * hop + np.arange(win)
                power = np.abs(np.fft.rfft(x[at] * window, n_fft)) ** 2
                mel = np.log(power @ bank.T + 1e-6).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * n_mels), pa.array(mel.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * n, b.column(0).type), pa.array(np.arange(n, dtype=np.int32)), lists], [key, "f", "mel"])

    return audio.select(key, samples).mapInArrow(run, f"{key} {audio.schema[key].dataType.simpleString()}, f int, mel array<float>")


def _components(vectors: DataFrame, keys: list[str]) -> DataFrame:
    return vectors.select(*keys, "f", F.posexplode("vec").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


def _vectors(parts: DataFrame, keys: list[str], value: str) -> DataFrame:
    return parts.groupBy(*keys, "f").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v")))), lambda x: x["v"]).alias("vec"))


def running_mean(vectors: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Mean of each component over the last ``width`` frames, fewer at the beginning: a causal stand-in for an encoder."""
    w = Window.partitionBy(*keys, "pos").orderBy("f").rowsBetween(1 - width, 0)
    return _vectors(_components(vectors, keys).withColumn("v", F.avg("v").over(w)), keys, "v")


def z_normalized(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Frames scaled as a whole series: (x - mean) / (sample standard deviation + 1e-7) over all components. A front end that needs the whole series runs before anything cuts it."""
    parts = _components(vectors, keys)
    series = parts.groupBy(*keys).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    return vectors.join(series, keys).select(*keys, "f", F.transform("vec", lambda x: (x.cast("double") - F.col("mean")) / (F.col("sd") + 1e-7)).alias("vec"))


def stitched(vectors: DataFrame, keys: list[str], segment: int, context: int, encode: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """An encoder over segments of ``segment`` frames, each with ``context`` frames to its left that are dropped again.

    A frame goes to its own segment and, as context, to later ones that it can still reach; so a series of any length is many small groups.
    """
    own = F.floor(F.col("f") / segment)
    placed = vectors.withColumn("__g", F.explode(F.sequence(own, F.floor((F.col("f") + context) / segment))))
    return encode(placed, [*keys, "__g"]).where(F.floor(F.col("f") / segment) == F.col("__g")).drop("__g")


def attention_pairs(frames: DataFrame, keys: list[str], block: int, left: int) -> DataFrame:
    """(keys, rule, q, k): frames that may look at each other; block: within a block; chunked-causal: also ``left`` blocks back; causal: the same, but never ahead.

    Frames meet by block, so only pairs of near blocks are made.
    """
    b = F.floor(F.col("f") / block)
    q = frames.select(*keys, F.col("f").alias("q"), b.alias("bq")).withColumn("b", F.explode(F.sequence(F.greatest(F.col("bq") - left, F.lit(0)), F.col("bq"))))
    pairs = q.join(frames.select(*keys, F.col("f").alias("k"), b.alias("b")), [*keys, "b"])
    rules = F.array(F.lit("chunked-causal"), F.when(F.col("b") == F.col("bq"), "block"), F.when(F.col("k") <= F.col("q"), "causal"))
    return pairs.select(*keys, F.explode(F.array_compact(rules)).alias("rule"), "q", "k")
