"""Sinks: derived tables by manifest, incremental feature tables, submission files."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, by: str, replace: bool = True) -> None:
    """Write a table partitioned by a column; with ``replace`` only the partitions that occur in ``df`` are replaced."""
    writer = df.write.partitionBy(by).mode("overwrite" if replace else "append")
    (writer.option("partitionOverwriteMode", "dynamic") if replace else writer).parquet(path)


def append_missing(df: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose ``key`` isn't there yet; returns the table. Running it again adds nothing."""
    spark = df.sparkSession
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(hadoop).exists(p):
        df = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    df.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def write_json_summary(df: DataFrame, path: str) -> None:
    """A small result as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def merge_json_summary(df: DataFrame, path: str, key: str) -> None:
    """A small result merged into one that is there: rows of the same ``key`` are replaced, others stay. It is written beside the old one and then takes its place."""
    spark = df.sparkSession
    old = spark.read.schema(df.schema).json(path).join(df.select(key), key, "left_anti") if table_exists(spark, path) else df.limit(0)
    write_json_summary(df.unionByName(old), f"{path}.new")
    fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jvm.java.net.URI(path), spark._jsc.hadoopConfiguration())
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs.delete(at(path), True)
    fs.rename(at(f"{path}.new"), at(path))


def predictions_document(events: DataFrame) -> DataFrame:
    """One JSON document per conversation of committed instants (events: conv_id, speaker, task, at in s), in order: conversation_id, speaker_1 and speaker_2 with eot and interruption."""
    times = events.groupBy("conv_id", "speaker", "task").agg(F.sort_array(F.collect_list("at")).alias("at"))
    of = lambda s, task: F.coalesce(F.max(F.when((F.col("speaker") == s) & (F.col("task") == task), F.col("at"))), F.array().cast("array<double>")).alias({"eot": "eot", "int": "interruption"}[task])
    doc = times.groupBy("conv_id").agg(*(of(s, task).alias(f"{task}{s}") for s in (0, 1) for task in ("eot", "int")))
    side = lambda s: F.struct(F.col(f"eot{s}").alias("eot"), F.col(f"int{s}").alias("interruption")).alias(f"speaker_{s + 1}")
    return doc.select(F.to_json(F.struct(F.col("conv_id").alias("conversation_id"), side(0), side(1))).alias("value"))


def write_wav_copy(audio: DataFrame, path: str) -> DataFrame:
    """16-bit PCM copies of recordings (stem, sr, samples) as a table of files: stem, sr, content. Bytes go where the table goes, so any store will do; resuming skips what is there."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for sr, channels in zip(b["sr"], b["samples"], strict=True):
                x = np.stack([np.asarray(c, np.float32) for c in channels])
                raw = io.BytesIO()
                with wave.open(raw, "wb") as w:
                    w.setnchannels(len(x))
                    w.setsampwidth(2)
                    w.setframerate(int(sr))
                    w.writeframes((np.clip(x.T, -1, 32767 / 32768) * 32768).round().astype("<i2").tobytes())
                out.append(raw.getvalue())
            yield pd.DataFrame({"stem": b["stem"], "sr": b["sr"], "content": out})

    copies = audio.where("samples is not null").select("stem", "sr", "samples").mapInPandas(encode, "stem string, sr bigint, content binary")
    return append_missing(copies, path, "stem")


def probabilities_document(probs: DataFrame, task: str, hz: float) -> DataFrame:
    """One JSON document per conversation: its probability series by speaker, in frame order (probs: conv_id, speaker, f, p)."""
    series = probs.groupBy("conv_id", "speaker").agg(F.sort_array(F.collect_list(F.struct("f", "p"))).alias("s")).select("conv_id", "speaker", F.transform("s", lambda x: x["p"]).alias("prob"))
    one = lambda k: F.struct(F.max(F.when(F.col("speaker") == k, F.col("prob"))).alias("prob"))
    doc = series.groupBy("conv_id").agg(one(0).alias("speaker_1"), one(1).alias("speaker_2"))
    return doc.select(F.to_json(F.struct(F.lit(task).alias("task"), F.lit(hz).alias("frame_rate_hz"), F.col("conv_id").alias("conversation_id"), "speaker_1", "speaker_2")).alias("value"))


def keep_best_and_last(runs: DataFrame, run: str, step: str, loss: str) -> DataFrame:
    """Of each run the row of the least loss and the one of the last step, once if they are the same."""
    best = runs.groupBy(run).agg(F.min_by(F.struct(*runs.columns), F.struct(F.col(loss), F.col(step))).alias("r"))
    last = runs.groupBy(run).agg(F.max_by(F.struct(*runs.columns), F.col(step)).alias("r"))
    return best.select("r.*").union(last.select("r.*")).distinct()


def table_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
