"""The chunk clock and stateful operators on streams of utterances and tokens."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from colloquy.tables import checkpoint_folder

FORGET_MS = 3_600_000  # after so long without a token a conversation is over
EPOCH_MS = 1_735_689_600_000  # event time 0 of every conversation: the start of 2025


def staged(df: DataFrame, at: str, end: str, files: int = 4) -> DataFrame:
    """A table as a stream of several files in order of ``at``, one file a batch, and behind them one row whose ``at`` is ``end`` and whose other columns are null: the end of the stream.

    With that row the watermark passes everything before it, so windows close and timers fire in append mode.
    """
    spark = df.sparkSession
    folder = checkpoint_folder(spark, "staged")
    cuts = df.selectExpr(f"percentile_approx({at}, array({', '.join(str((k + 1) / files) for k in range(files - 1))})) as c").first()[0] or []
    last = None
    for hi in [*cuts, None]:
        part = df if last is None else df.where(F.col(at) > F.lit(last))
        (part if hi is None else part.where(F.col(at) <= F.lit(hi))).coalesce(1).write.mode("append").parquet(folder)
        last = hi
    marker = spark.range(1).select(*(F.lit(end).cast(f.dataType).alias(f.name) if f.name == at else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema))
    marker.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream over all that is there, in append mode, and return what it wrote, as a table in the shared folder; every batch adds its rows, and one that is run again replaces its own."""
    spark = stream.sparkSession
    folder = checkpoint_folder(spark, "stream")

    def write(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={no}")

    query = stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/*")


def chunk_activity(utterances: DataFrame, width: str, late: str) -> DataFrame:
    """Utterances and their length per tumbling window of event time ``ts``: start, n, ms."""
    return utterances.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.sum("ms").alias("ms")).select(F.col("window.start").alias("start"), "n", "ms")


def talk_sessions(utterances: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of a conversation without a pause of ``gap``: conv_id, start, end, n."""
    s = utterances.withWatermark("ts", late).groupBy("conv_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return s.select("conv_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class EmissionQueue:
    """At most m tokens leave per chunk, first come first served: a token waits for the one m places before it.

    The state is the chunks of the last m tokens and the last speaker, whatever the length of the stream.
    """

    def __init__(self, m: int, delay: int, chunk_ms: int, state: str | None = None):
        self.m, self.delay, self.chunk_ms = m, delay, chunk_ms
        self.recent, self.speaker = json.loads(state) if state else ([], None)

    def push(self, end_ms: int, speaker: int) -> tuple[int, bool]:
        """Chunk in which the token leaves, and whether the speaker changes before it."""
        e = end_ms // self.chunk_ms + self.delay
        if len(self.recent) == self.m:
            e = max(e, self.recent[0] + 1)
        if self.recent:
            e = max(e, self.recent[-1])
        self.recent = [*self.recent, e][-self.m :]
        tag, self.speaker = speaker != self.speaker, speaker
        return e, tag

    def state(self) -> str:
        return json.dumps([self.recent, self.speaker])


def emit_tokens(tokens: DataFrame, m: int = 4, delay: int = 2, chunk_ms: int = 80, late: str = "1 second") -> DataFrame:
    """Stream of conv_id, tid, speaker, end_ms, ts (event time of the end) -> conv_id, tid, e, tag, flushed.

    A token goes out once the clock of its conversation, its latest end, has come to its chunk; until then it is held. When the watermark has
    passed the latest end by ``late``, a timer flushes what is held; an hour later another one drops the state. Tokens of a conversation may come in any order within ``late``: what is held is
    scheduled anew with each batch, what has gone out is not; a token that comes later takes the place that is left.
    """
    wait_ms = 1000 * int(late.split()[0])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return
        queue_state, held, now = json.loads(state.get[0]) if state.exists else (None, [], -1)
        held = [tuple(x) for x in held]
        for b in batches:  # a batch at a time; only what is held stays
            b = b.dropna(subset=["tid"])
            held += [(int(t), int(s), int(i)) for t, s, i in zip(b["end_ms"], b["speaker"], b["tid"], strict=True)]
        if not held and not state.hasTimedOut:
            return
        held.sort()
        now = max([now, *(x[0] // chunk_ms for x in held)])
        queue, out, left = EmissionQueue(m, delay, chunk_ms, queue_state), [], []
        for k, (end, speaker, tid) in enumerate(held):
            before = queue.state()
            e, tag = queue.push(end, speaker)
            if e > now and not state.hasTimedOut:
                queue, left = EmissionQueue(m, delay, chunk_ms, before), held[k:]
                break
            out.append((key[0], tid, e, tag, state.hasTimedOut))
        if state.hasTimedOut and not held:
            state.remove()
        else:  # after a flush the queue is remembered for as long as a pause may be
            due = state.getCurrentWatermarkMs() + FORGET_MS if state.hasTimedOut else EPOCH_MS + (now + delay + 1) * chunk_ms + wait_ms
            state.update((json.dumps([queue.state(), left, now]),))
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["conv_id", "tid", "e", "tag", "flushed"])

    # rows without a conversation stay up to here: they move the watermark, and a filter would go below it
    grouped = tokens.withWatermark("ts", late).groupBy("conv_id")
    return grouped.applyInPandasWithState(step, "conv_id string, tid bigint, e bigint, tag boolean, flushed boolean", "state string", "append", GroupStateTimeout.EventTimeTimeout)


@dataclass
class ChunkDecoder:
    """Greedy decoding, chunk by chunk: after each chunk's audio, tokens go out until the sign for the next chunk wins or ``m`` have gone out.

    A speaker token changes the speaker and is free; blocked tokens are never taken; ``next_bias`` is taken off the sign's score. ``speaker`` and ``forced`` (how often
    the sign was forced) are all that goes on from chunk to chunk. What the scores are is the caller's: ``scores(emitted)`` gives (token, score) pairs and the sign's score.
    """

    m: int = 4
    next_bias: float = 0.0
    speakers: tuple[int, ...] = (-1, -2)
    blocked: frozenset[int] = frozenset()
    speaker: int = 0
    forced: int = 0

    def chunk(self, scores: Callable[[list[int]], tuple[list[tuple[int, float]], float]]) -> list[tuple[int, int]]:
        out, taken, n = [], [], 0
        while True:
            pairs, stop = scores(taken)
            pairs = [(s, -t) for t, s in pairs if t not in self.blocked]
            best = max(pairs, default=None)
            if best is None or best[0] <= stop - self.next_bias:
                return out
            token = -best[1]
            if token in self.speakers:
                self.speaker = self.speakers.index(token)
            elif n >= self.m:
                self.forced += 1
                return out
            else:
                n += 1
                out.append((token, self.speaker))
            taken.append(token)


def decode_chunks(chunks: DataFrame, m: int = 4, next_bias: float = 0.0) -> DataFrame:
    """Stream of conv_id, chunk, stop, candidates array<struct<token, score>> -> conv_id, chunk, token, speaker, forced (so far).

    Chunks of a conversation must come in order over the batches, within one in any. A candidate is offered until it is taken.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        decoder = ChunkDecoder(m, next_bias)
        decoder.speaker, decoder.forced = state.get if state.exists else (0, 0)
        rows, out = [], []
        for b in batches:
            rows += [(int(k), float(stop), [(int(c["token"]), float(c["score"])) for c in cand]) for k, stop, cand in b[["chunk", "stop", "candidates"]].dropna().itertuples(index=False)]
        for k, stop, pairs in sorted(rows):
            got = decoder.chunk(lambda taken, pairs=pairs, stop=stop: ([p for p in pairs if p[0] not in taken], stop))
            out += [(key[0], k, t, s, decoder.forced) for t, s in got]
        state.update((decoder.speaker, decoder.forced))
        yield pd.DataFrame(out, columns=["conv_id", "chunk", "token", "speaker", "forced"])

    return chunks.where("conv_id is not null").groupBy("conv_id").applyInPandasWithState(step, "conv_id string, chunk bigint, token bigint, speaker int, forced int", "speaker int, forced int", "append", GroupStateTimeout.NoTimeout)


def online_activity(frames: DataFrame, up: float, down: float) -> DataFrame:
    """Stream of conv_id, f, db -> conv_id, f, on: activity begins above ``up`` and goes on while above ``down``; the state is one bit. Frames must come in order over the batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        on = state.get[0] if state.exists else False
        rows = sorted((int(f), float(db)) for b in batches for f, db in b[["f", "db"]].dropna().itertuples(index=False))
        out = []
        for f, db in rows:
            on = db > up or (on and db > down)
            out.append((key[0], f, on))
        state.update((on,))
        yield pd.DataFrame(out, columns=["conv_id", "f", "on"])

    return frames.where("conv_id is not null").groupBy("conv_id").applyInPandasWithState(step, "conv_id string, f bigint, on boolean", "on boolean", "append", GroupStateTimeout.NoTimeout)
