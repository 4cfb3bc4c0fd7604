"""Access to the tables and the few conventions all operators share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data set, as a plain Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(seconds: Column | str) -> Column:
    """Seconds as whole milliseconds; null and NaN give null."""
    c = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.when(~F.isnan(c), F.round(c * 1000)).cast("bigint")


def usable_utterances(utterance: DataFrame, *extra: str) -> DataFrame:
    """Utterances with both times set and ``end_ms > start_ms``; adds the two columns.

    Only ``conv_id``, ``extra`` and the times are kept, so that no more is read.
    """
    timed = utterance.select("conv_id", *extra, millis("start_s").alias("start_ms"), millis("end_s").alias("end_ms"))
    return timed.where((F.col("end_ms") > F.col("start_ms")) & F.col("conv_id").isNotNull())


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a local one only where none is set and the master is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="colloquy-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own under the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid4()}"
