"""Corpus readers: subtitle text, nested JSON, JSON lines and nested Parquet into the conversation model."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from colloquy.operators.coverage import periods_and_gaps
from colloquy.schema import SPEECH_LABELS
from colloquy.tables import checkpointed

UTTERANCE = T.StructType([T.StructField("conv_id", T.StringType()), T.StructField("speaker", T.IntegerType()), T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("label", T.StringType())])
ALIGNMENT = "struct<speaker:int,start:double,end:double,text:string,tokens:array<struct<id:bigint,text:string,end_time:double>>>"
CONVERSATION_JSON = (
    "File struct<FileName:string,FileLength:string>, Speaker1 struct<ID:string>, Speaker2 struct<ID:string>, ConversationInfo struct<Domain:string>, "
    "Conversation array<struct<SpeakerNo:string,StartTime:string,EndTime:string,Text:string,SpeakerEmotionCategory:string>>"
)


def number(c: Column) -> Column:
    """A number with thousands separators; what isn't one gives null."""
    return F.regexp_replace(c, ",", "").try_cast("double")


def srt_seconds(c: Column) -> Column:
    """Seconds of ``H:M:S,mmm``."""
    p = r"^\s*(\d+):(\d+):(\d+)[,.](\d+)\s*$"
    part = lambda i: F.regexp_extract(c, p, i).try_cast("double")
    return (part(1) * 60 + part(2)) * 60 + part(3) + part(4) / F.pow(F.lit(10.0), F.length(F.regexp_extract(c, p, 4)))


def parse_srt(files: DataFrame, content: str, *keep: str) -> DataFrame:
    """Blocks of subtitle files: keep, no, start_s, end_s, label, text.

    Blocks are split at blank lines; one of fewer than three lines or without ``-->`` is skipped;
    a leading ``[label]`` becomes the label, else it is empty.
    """
    blocks = files.select(*keep, F.posexplode(F.split(F.regexp_replace(content, "\r\n?", "\n"), r"\n[ \t]*\n")).alias("no", "block"))
    lines = F.filter(F.split("block", "\n"), lambda x: F.trim(x) != "")
    b = blocks.withColumn("l", lines).where((F.size("l") >= 3) & F.contains(F.get("l", F.lit(1)), F.lit("-->")))
    times = F.split(F.get("l", F.lit(1)), "-->")
    body = F.trim(F.array_join(F.slice("l", 3, F.greatest(F.size("l") - 2, F.lit(0))), " "))
    label = r"^\[([^\]]*)\]\s*"
    b = b.select(*keep, "no", srt_seconds(F.get(times, F.lit(0))).alias("start_s"), srt_seconds(F.get(times, F.lit(1))).alias("end_s"), F.regexp_extract(body, label, 1).alias("label"), F.regexp_replace(body, label, "").alias("text"))
    return b.where("start_s is not null and end_s is not null")


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """Subtitle directories ``<conversation>/speaker_<n>_annotation_<x>.srt``: conv_id, speaker, ..."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.srt").text(path, wholetext=True).withColumn("file", F.input_file_name())
    where = files.select("value", F.concat(F.lit("oto-"), F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)).alias("conv_id"), (F.regexp_extract("file", r"speaker_(\d+)", 1).try_cast("int") - 1).alias("speaker"))
    return parse_srt(where, "value", "conv_id", "speaker").drop("no")


def read_conversation_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested conversation files: one row per utterance in the model; a speaker number that ends in 1 is speaker 0."""
    j = spark.read.schema(CONVERSATION_JSON).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    u = j.select(F.regexp_replace(F.col("File.FileName"), r"\.[^.]*$", "").alias("conv_id"), F.col("ConversationInfo.Domain").alias("domain"), F.explode("Conversation").alias("u"))
    speaker = F.when(F.col("u.SpeakerNo").endswith("1"), 0).otherwise(1)
    return u.select("conv_id", "domain", speaker.alias("speaker"), number(F.col("u.StartTime")).alias("start_s"), number(F.col("u.EndTime")).alias("end_s"), F.trim("u.Text").alias("text"), F.col("u.SpeakerEmotionCategory").alias("label"))


def parse_jsonl(lines: DataFrame, value: str, schema: str, *keep: str) -> DataFrame:
    """Rows of JSON lines; blank lines, lines with NUL and lines that don't parse are skipped."""
    ok = lines.where((F.trim(value) != "") & ~F.contains(F.col(value), F.lit("\x00")))
    full = schema[:-1] + ",_bad:string>"
    j = ok.select(*keep, F.from_json(value, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("j"))
    return j.where("j is not null and j._bad is null").select(*keep, "j.*").drop("_bad")


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines of every file: conv_id from the file's name, speaker, start, end, text, tokens."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).withColumn("conv_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl$", 1))
    return parse_jsonl(lines, "value", ALIGNMENT, "conv_id")


def read_benchmark(spark: SparkSession, path: str, annotator: str = "a") -> DataFrame:
    """Nested Parquet rows with a list of annotations per speaker: one row per utterance; only the annotation columns are read."""
    t = spark.read.parquet(path)
    parts = [t.select(F.col("conversation_id").alias("conv_id"), F.lit(s).alias("speaker"), F.inline(f"speaker_{s + 1}_annotation_{annotator}")) for s in (0, 1)]
    return parts[0].unionByName(parts[1]).select("conv_id", "speaker", "start_s", "end_s", "text", "label")


def latest_snapshot(rows: DataFrame, snapshot: str, key: str, *order: str) -> DataFrame:
    """Rows of the latest snapshot, one per key: the first in the order of ``order`` (of all other columns if none is given)."""
    last = rows.agg(F.max(snapshot).alias(snapshot))
    of_last = rows.join(F.broadcast(last), snapshot)  # last: one row
    by = [F.col(c) for c in order] or [F.xxhash64(*(c for c in rows.columns if c != key))]
    k = F.row_number().over(Window.partitionBy(key).orderBy(*by))
    return of_last.withColumn("__k", k).where("__k = 1").drop("__k")


def decoded(content: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and samples (channels x frames, -1 to 1) of a PCM file."""
    with wave.open(io.BytesIO(content)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit PCM is read")
        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768
        return w.getframerate(), x.reshape(-1, w.getnchannels()).T


def resampled(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Samples (channels x frames) at another rate: linear between samples, behind a mean over the frames that one output frame covers when the rate falls."""
    if rate == target or not x.shape[1]:
        return x
    n = round(x.shape[1] * target / rate)
    k = rate // target
    if k > 1:
        total = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x, axis=1, dtype=np.float64)], axis=1)
        lo = np.clip(np.arange(x.shape[1]) - k // 2, 0, None)
        hi = np.minimum(lo + k, x.shape[1])
        x = ((total[:, hi] - total[:, lo]) / (hi - lo)).astype(np.float32)
    at = np.arange(n) * rate / target
    return np.stack([np.interp(at, np.arange(x.shape[1]), c) for c in x]).astype(np.float32)


def read_wav(spark: SparkSession, path: str, target: int | None = None) -> DataFrame:
    """PCM files, at ``target`` samples a second if given: path, stem, sr, samples (a list per channel), error. A file that can't be read has its error and nothing else."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, raw in zip(b["path"], b["content"], strict=True):
                stem = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    sr, x = decoded(raw)
                    x = resampled(x, sr, target or sr)
                    rows.append((p, stem, target or sr, [c.tolist() for c in x], None))
                except (wave.Error, EOFError, ValueError) as e:
                    rows.append((p, stem, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "stem", "sr", "samples", "error"]).astype({"sr": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", "content").mapInPandas(decode, "path string, stem string, sr bigint, samples array<array<float>>, error string")


def bad_files(audio: DataFrame) -> DataFrame:
    """Files that can't be read, and why."""
    return audio.where("error is not null").select("path", "error")


def audio_window(samples: Column, sr: Column, start_s: Column, n: int) -> Column:
    """``n`` samples of every channel from an instant on, padded with silence; without audio, silence."""
    first = F.floor(start_s * sr).cast("int")
    cut = lambda c: F.concat(F.slice(c, first + 1, n), F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), n - F.greatest(F.lit(0), F.size(c) - first))))
    return F.coalesce(F.transform(samples, cut), F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), n), 2))


def activity_of_audio(audio: DataFrame, hop_ms: int = 20) -> DataFrame:
    """Energy-based activity of every channel: stem, speaker, i, j, in frames. An Arrow kernel per file; thresholds as in ``hysteresis``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for stem, sr, channels in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                for speaker, x in enumerate(channels or []):
                    rows += [(stem, speaker, i, j) for i, j in active_runs(np.asarray(x, np.float64), int(sr * hop_ms / 1000))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["stem", "speaker", "i", "j"])

    return audio.where("samples is not null").select("stem", "sr", "samples").mapInArrow(run, "stem string, speaker int, i bigint, j bigint")


def active_runs(x: np.ndarray, block: int, min_silence: int = 10, min_speech: int = 5) -> list[tuple[int, int]]:
    """Runs of active blocks of one channel: hysteresis on the energy, short silences filled, then short bursts dropped."""
    n = len(x) // block
    if not n:
        return []
    db = 10 * np.log10((x[: n * block].reshape(n, block) ** 2).mean(1) + 1e-10)
    floor = np.percentile(db, 10)
    state = np.where(db > max(-40, floor + 12), 1, np.where(db <= max(-45, floor + 8), 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(n), -1))
    on = np.where(known >= 0, state[known], 0)
    for value, least in ((0, min_silence), (1, min_speech)):
        edges = np.flatnonzero(np.diff(on)) + 1
        for a, z in zip(np.append(0, edges), np.append(edges, n), strict=True):
            if on[a] == value and z - a < least:
                on[a:z] = 1 - value
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def speech_segments(utterances: DataFrame) -> DataFrame:
    """Activity from labels: conv_id, speaker, i, j of utterances whose label is a kind of speech, merged, in frames of 20 ms."""
    frame = lambda c: F.bround(F.round(F.col(c) * 1000) / 20).cast("bigint")
    said = utterances.where(F.col("label").isin(*SPEECH_LABELS)).select("conv_id", "speaker", frame("start_s").alias("i"), frame("end_s").alias("j"))
    return periods_and_gaps(said, ["conv_id", "speaker"], "i", "j").where("kind = 'period'").drop("kind")


@dataclass(frozen=True)
class Corpus:
    """A corpus in the model. conversations: conv_id, source, duration (s), vad_source, meta (map); utterances: UTTERANCE; segments: conv_id, speaker, i, j."""

    conversations: DataFrame
    utterances: DataFrame
    segments: DataFrame

    def only(self, ids: list[str] | None = None, limit: int | None = None) -> Corpus:
        """The conversations of a list, and of those the first ``limit`` in order of id, numbers in ids by value."""
        c = self.conversations if ids is None else self.conversations.where(F.col("conv_id").isin(*ids))
        if limit is not None:
            c = c.orderBy(F.regexp_extract("conv_id", r"^(.*?)[0-9]*$", 1), F.regexp_extract("conv_id", r"([0-9]+)$", 1).try_cast("bigint"), "conv_id").limit(limit)
        keep = lambda x: x.join(c.select("conv_id"), "conv_id", "left_semi")
        return Corpus(c, keep(self.utterances), keep(self.segments))


def _finish(source: str, vad_source: str, named: DataFrame, utterances: DataFrame, segments: DataFrame, audio_s: DataFrame | None = None) -> Corpus:
    """Conversations by name (conv_id, meta), with the length of their audio or else their last utterance's end."""
    last = utterances.groupBy("conv_id").agg(F.max("end_s").alias("last"))
    c = named.join(last, "conv_id", "left")
    c = c.join(audio_s, "conv_id", "left") if audio_s is not None else c.withColumn("audio_s", F.lit(None).cast("double"))
    duration = F.coalesce("audio_s", "last", F.lit(0.0))
    return Corpus(c.select("conv_id", F.lit(source).alias("source"), duration.alias("duration"), F.lit(vad_source).alias("vad_source"), "meta"), utterances, segments)


def stereo_corpus(spark: SparkSession, root: str, labels: str | None = None) -> Corpus:
    """Two-channel recordings with nested label files of the same stem.

    Activity is measured from the samples. The labels' speakers are exchanged where the first one's words lie on the second channel for longer
    (a tie keeps them); meta says so. A recording without labels has no utterances.
    """
    audio = checkpointed(read_wav(spark, root).where("error is null"))
    seg = checkpointed(activity_of_audio(audio).withColumnRenamed("stem", "conv_id"))
    said = read_conversation_json(spark, labels or root)
    frame = lambda c: F.bround(F.round(F.col(c) * 1000) / 20).cast("bigint")
    first = periods_and_gaps(said.where("speaker = 0").select("conv_id", frame("start_s").alias("i"), frame("end_s").alias("j")), ["conv_id"], "i", "j").where("kind = 'period'")
    cells = lambda x, a, b: x.withColumn("c", F.explode(F.sequence(F.floor(F.col(a) / 1000), F.floor((F.col(b) - 1) / 1000))))
    met = cells(first.select("conv_id", F.col("i").alias("i2"), F.col("j").alias("j2")), "i2", "j2").join(cells(seg, "i", "j"), ["conv_id", "c"])
    shared = F.greatest(F.lit(0), F.least("j", "j2", (F.col("c") + 1) * 1000) - F.greatest("i", "i2", F.col("c") * 1000))
    on = lambda s: F.sum(F.when(F.col("speaker") == s, shared).otherwise(0))
    swap = met.groupBy("conv_id").agg((on(1) > on(0)).alias("swap"))
    files = audio.select(F.col("stem").alias("conv_id"), (F.size(F.element_at("samples", 1)) / F.col("sr")).alias("audio_s"))
    domain = said.groupBy("conv_id").agg(F.first("domain").alias("domain"))
    swapped = F.coalesce("swap", F.lit(False))
    meta = F.map_from_arrays(F.array(F.lit("domain"), F.lit("speaker_channel_swapped")), F.array(F.col("domain"), swapped.cast("string")))
    named = files.select("conv_id").join(domain, "conv_id", "left").join(swap, "conv_id", "left").select("conv_id", meta.alias("meta"))
    u = said.join(swap, "conv_id", "left").withColumn("speaker", F.when(swapped, 1 - F.col("speaker")).otherwise(F.col("speaker"))).select(*UTTERANCE.fieldNames())
    return _finish("stereo", "energy", named, u.join(files.select("conv_id"), "conv_id", "left_semi"), seg, files)


def directory_corpus(spark: SparkSession, root: str) -> Corpus:
    """A directory per conversation with metadata.json, subtitles per speaker and optionally recordings. Ids are oto- and the task id, else the directory's name; activity comes from the labels."""
    named = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.json").text(root, wholetext=True).withColumn("file", F.input_file_name())
    folder = F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)
    meta = F.from_json("value", "map<string,string>")
    named = named.select(F.concat(F.lit("oto-"), folder).alias("dir_id"), F.concat(F.lit("oto-"), F.coalesce(meta["task_id"], folder)).alias("conv_id"), meta.alias("meta"))
    said = read_srt(spark, root).withColumnRenamed("conv_id", "dir_id").join(named.select("dir_id", "conv_id"), "dir_id").select(*UTTERANCE.fieldNames())
    audio = read_wav(spark, root).where("error is null").select(F.concat(F.lit("oto-"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).alias("dir_id"), (F.size(F.element_at("samples", 1)) / F.col("sr")).alias("s"))
    length = audio.join(named.select("dir_id", "conv_id"), "dir_id").groupBy("conv_id").agg(F.max("s").alias("audio_s"))
    return _finish("otoSpeech", "label", named.select("conv_id", "meta"), said, speech_segments(said), length)


def benchmark_corpus(spark: SparkSession, root: str, annotator: str = "a") -> Corpus:
    """Nested Parquet rows under snapshot folders (``<snapshot>/data/*.parquet``, or files alone), of which the latest holds; ids are tb- and the conversation's."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(root)
    snapshot = F.regexp_extract(F.input_file_name(), r"([^/]+)/data/[^/]*$", 1)
    t = latest_snapshot(t.withColumns({"__snapshot": snapshot, "__file": F.input_file_name()}), "__snapshot", "conversation_id", "__file")
    key = F.concat(F.lit("tb-"), F.col("conversation_id").cast("string"))
    parts = [t.select(key.alias("conv_id"), F.lit(s).alias("speaker"), F.inline(f"speaker_{s + 1}_annotation_{annotator}")) for s in (0, 1)]
    said = parts[0].unionByName(parts[1]).select("conv_id", "speaker", "start_s", "end_s", "text", "label")
    meta = F.col("metadata") if "metadata" in t.columns else F.create_map().cast("map<string,string>")
    return _finish("turnbench-dev", "label", t.select(key.alias("conv_id"), meta.alias("meta")), said, speech_segments(said))


def benchmark_audio(spark: SparkSession, root: str, ids: list[str]) -> DataFrame:
    """The encoded channels of a few conversations: conv_id, speaker, content. Only ids and audio columns are read, and of those only row groups that may hold one of the ids."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(root).where(F.col("conversation_id").cast("string").isin(*(i.removeprefix("tb-") for i in ids)))
    parts = [t.select(F.concat(F.lit("tb-"), F.col("conversation_id").cast("string")).alias("conv_id"), F.lit(s).alias("speaker"), F.col(f"speaker_{s + 1}_audio.bytes").alias("content")) for s in (0, 1)]
    return parts[0].unionByName(parts[1]).dropDuplicates(["conv_id", "speaker"])


def read_audio(spark: SparkSession, source: str, root: str, target: int = 16_000) -> DataFrame:
    """Recordings of a source as conv_id, sr, samples (a list per speaker); an unknown source is an error. Channels of unlike length are cut to the shorter."""
    if source == "stereo":
        return read_wav(spark, root, target).where("error is null").select(F.col("stem").alias("conv_id"), "sr", "samples")
    if source == "otoSpeech":
        x = read_wav(spark, root, target).where("error is null").select(F.concat(F.lit("oto-"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).alias("conv_id"), F.regexp_extract("stem", r"speaker_(\d+)", 1).alias("k"), "sr", F.element_at("samples", 1).alias("x"))
        both = x.groupBy("conv_id").agg(F.max("sr").alias("sr"), F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda c: c["x"]).alias("samples"))
        n = F.array_min(F.transform("samples", lambda c: F.size(c)))
        return both.withColumn("n", n).select("conv_id", "sr", F.transform("samples", lambda c: F.slice(c, F.lit(1), F.col("n"))).alias("samples"))
    raise ValueError(f"no source {source!r}")


CORPORA = {"stereo": stereo_corpus, "otoSpeech": directory_corpus, "turnbench-dev": benchmark_corpus}


def read_corpus(spark: SparkSession, name: str, root: str, only: list[str] | None = None, limit: int | None = None) -> Corpus:
    """A corpus by name; an unknown name is an error."""
    if name not in CORPORA:
        raise ValueError(f"no corpus {name!r}; there are {', '.join(CORPORA)}")
    return CORPORA[name](spark, root).only(only, limit)


def dashboard(pages: DataFrame) -> DataFrame:
    """Open tasks of pages with ``fields`` (see front_matter): owner, priority (p9 if none), due (9999 if none), title; in order of owner, priority, due."""
    f = lambda k, default=None: F.coalesce(F.col("fields")[k], F.lit(default))
    open_ = pages.where(F.col("fields")["status"].isin("open", "doing", "blocked"))
    return open_.select(f("owner", "nobody").alias("owner"), f("priority", "p9").alias("priority"), f("due", "9999").alias("due"), f("title").alias("title")).orderBy("owner", "priority", "due", "title")


def front_matter(files: DataFrame, content: str, *keep: str) -> DataFrame:
    """``key: value`` lines between the first two ``---`` of a text, as a map."""
    head = F.regexp_extract(content, r"(?s)^---\n(.*?)\n---", 1)
    entries = r"map_from_entries(transform(filter(split(__h, '\n'), x -> x like '%:%'), x -> struct(trim(substring_index(x, ':', 1)), trim(substr(x, instr(x, ':') + 1)))))"
    return files.withColumn("__h", head).select(*keep, F.expr(entries).alias("fields"))
