"""Capacity-limited emission of timed tokens into chunks.

At each chunk at most ``m`` tokens leave, in order of (end, speaker, stream order); the rest wait. The
queue has a closed form: with rank i, r = i mod m, q = i div m and bucket b, token i leaves
in chunk q + max(b - q) over the tokens of equal r up to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


ORDER = ("end_ms", "speaker", "tid")  # in which tokens leave
LANES = 8  # up to so many tokens a chunk, all running maxima go by this order, and a queue is sorted once


def schedule(tokens: DataFrame, length: DataFrame | None, m: int | None, delay: int, chunk_ms: int = 80, key: str = "conv_id") -> DataFrame:
    """Chunk of every token: key, [m,] tid, speaker, b, e, n_chunks, text columns of ``tokens``.

    ``tokens``: key, speaker, tid (stream order), end_ms; ``length``: key, ms. With ``m`` None the tokens
    carry a column ``m`` and each (key, m) is a queue of its own; with ``length`` None they carry ``n_chunks``. A token whose bucket lies at or
    beyond the last chunk is dropped; one that leaves at or after it has e >= n_chunks (flushed).
    """
    x = tokens if length is None else tokens.join(chunk_counts(length, key, chunk_ms), key)
    x = x.withColumn("b", F.least(F.col("n_chunks"), F.floor(F.col("end_ms") / chunk_ms) + delay)).where("b < n_chunks")
    if m is not None:
        x = x.withColumn("m", F.lit(m))
    queue = Window.partitionBy(key, "m").orderBy(*ORDER)
    i = F.row_number().over(queue) - 1
    x = x.withColumn("i", i.cast("bigint")).withColumns({"r": F.col("i") % F.col("m"), "q": F.floor(F.col("i") / F.col("m"))})
    late, past = F.col("b") - F.col("q"), (Window.unboundedPreceding, 0)
    if m is not None and m <= LANES:
        most = F.coalesce(*(F.when(F.col("r") == k, F.max(F.when(F.col("r") == k, late)).over(queue.rowsBetween(*past))) for k in range(m)))
    else:
        most = F.max(late).over(Window.partitionBy(key, "m", "r").orderBy("q").rowsBetween(*past))
    return x.withColumn("e", (F.col("q") + most).cast("bigint")).drop("r", "q")


def chunk_counts(length: DataFrame, key: str = "conv_id", chunk_ms: int = 80) -> DataFrame:
    """key, n_chunks."""
    return length.select(key, F.ceil(F.col("ms") / chunk_ms).cast("bigint").alias("n_chunks"))


def speaker_tags(scheduled: DataFrame, key: str = "conv_id") -> DataFrame:
    """Add ``tag``: whether a speaker tag goes before the token (never among flushed ones)."""
    before = F.lag("speaker").over(Window.partitionBy(key, "m").orderBy("i"))
    return scheduled.withColumn("tag", (F.col("e") < F.col("n_chunks")) & (before.isNull() | (before != F.col("speaker"))))


def emission_stats(scheduled: DataFrame, length: DataFrame, key: str = "conv_id", chunk_ms: int = 80) -> DataFrame:
    """Per queue: chunks, tokens emitted, overflow (token-chunks waited), tokens that waited at all, largest backlog."""
    out = F.least("e", "n_chunks")
    moves = scheduled.select(key, "m", F.explode(F.array(F.struct(F.col("b").alias("k"), F.lit(1).alias("v")), F.struct(out.alias("k"), F.lit(-1).alias("v")))).alias("x")).select(key, "m", "x.*")
    at = moves.groupBy(key, "m", "k").agg(F.sum("v").alias("v"))
    level = at.withColumn("level", F.sum("v").over(Window.partitionBy(key, "m").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    backlog = level.groupBy(key, "m").agg(F.max("level").alias("max_backlog"))
    sums = scheduled.groupBy(key, "m").agg(
        F.first("n_chunks").alias("chunks"), F.count(F.when(F.col("e") < F.col("n_chunks"), 1)).alias("tokens"), F.sum(out - F.col("b")).alias("overflow_tokens"), F.count(F.when(out > F.col("b"), 1)).alias("distinct_overflow")
    )
    return sums.join(backlog, [key, "m"])


def chunk_histogram(scheduled: DataFrame, length: DataFrame, key: str = "conv_id", chunk_ms: int = 80) -> DataFrame:
    """How many chunks emit how many tokens: m, n_tokens, n (silent chunks included)."""
    full = scheduled.where("e < n_chunks").groupBy(key, "m", "e").agg(F.count("*").alias("n_tokens"))
    some = full.groupBy("m", "n_tokens").agg(F.count("*").alias("n"))
    queues = scheduled.select(key, "m", "n_chunks").distinct().groupBy("m").agg(F.sum("n_chunks").alias("all"))
    silent = some.groupBy("m").agg(F.sum("n").alias("some")).join(queues, "m").select("m", F.lit(0).cast("bigint").alias("n_tokens"), (F.col("all") - F.col("some")).alias("n"))
    return some.unionByName(silent)


def model_sequence(scheduled: DataFrame, length: DataFrame, key: str = "conv_id", chunk_ms: int = 80, slots: int = 1) -> DataFrame:
    """One row per item of the sequence: key, pos, kind (audio, tag, token, next), chunk, tid, label.

    A chunk is an audio slot (or ``slots`` of them, one per speaker), its emissions and the sign for the next chunk. The label of an audio slot is
    -100; of a token its tid, of a tag -1 - speaker, of the sign -10. Tokens leave in order, so that an item's place follows from the number of
    items before its chunk: only tokens are exchanged and sorted, and the slots of the stretch behind each are made where they are.
    """
    n = F.ceil(F.col("ms") / chunk_ms).cast("bigint")
    # rows of emitted tokens: ``k`` items up to this one, and of the last of a chunk the next chunk that emits
    w = Window.partitionBy(key).orderBy("i")
    size = F.when(F.col("tag"), 2).otherwise(1)
    mark = length.select(key, n.alias("n_chunks")).where("n_chunks > 0").select(key, F.lit(-1).cast("bigint").alias("i"), F.lit(-1).cast("bigint").alias("e"), "n_chunks", F.lit(None).cast("bigint").alias("tid"), F.lit(None).cast("bigint").alias("speaker"), F.lit(0).alias("size"))
    spoken = speaker_tags(scheduled, key).where("e < n_chunks").select(key, "i", "e", "n_chunks", F.col("tid").cast("bigint").alias("tid"), F.col("speaker").cast("bigint").alias("speaker"), size.alias("size"))
    x = mark.unionByName(spoken).withColumns({"k": F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)), "following": F.coalesce(F.lead("e").over(w), F.col("n_chunks"))})
    # a chunk c >= 0 begins at c * (slots + 1) and the items before it; behind row (e, k) the signs of chunks e to following - 1 and the audio of chunks e + 1 to following come after k items
    row = lambda when, kind, pos, tid, label: F.when(when, F.struct(pos.cast("int").alias("pos"), F.lit(kind).alias("kind"), F.col("c").alias("chunk"), tid.alias("tid"), label.cast("bigint").alias("label")))
    none, zero, e, k, c = F.lit(None).cast("bigint"), F.lit(0), F.col("e"), F.col("k"), F.col("c")
    here, at = (c == e) & (F.col("i") >= 0), F.greatest(e + 1, zero) * slots + F.greatest(e, zero) + k - 1
    begin = c * (slots + 1) + k
    rows = [row(here & (F.col("size") == 2), "tag", at - 1, none, -1 - F.col("speaker")), row(here, "token", at, F.col("tid"), F.col("tid"))]
    rows += [row((c >= 0) & (c > e) & (c < F.col("n_chunks")), "audio", begin + s, none, F.lit(-100)) for s in range(slots)]
    rows.append(row((c >= 0) & (c < F.col("following")), "next", begin + slots, none, F.lit(-10)))
    chunks = x.withColumn("c", F.explode(F.sequence("e", F.greatest("e", "following"))))
    return chunks.select(key, F.explode(F.array(*rows)).alias("x")).where("x is not null").select(key, "x.*")


def sequence_sums(scheduled: DataFrame, length: DataFrame, key: str = "conv_id", chunk_ms: int = 80) -> DataFrame:
    """Sums over the items of model_sequence(): key, kind, n, pos_sum, check_sum (of position times label, a decimal: tids times places soon leave a bigint).

    No chunk is made: each tag or token moves the audio slots of the chunks after its own by one place, and the signs also of its own.
    """
    queue = Window.partitionBy(key, "m").orderBy(*ORDER)
    before, e, n, wide = F.lag("speaker").over(queue), F.col("e"), F.col("n_chunks"), "decimal(38,0)"
    x = scheduled.withColumn("tag", before.isNull() | (before != F.col("speaker"))).where("e < n_chunks").withColumn("size", F.when(F.col("tag"), 2).otherwise(1))
    at = F.greatest(e + 1, F.lit(0)) + F.greatest(e, F.lit(0)) + F.sum("size").over(queue.rowsBetween(Window.unboundedPreceding, 0)) - 1
    x = x.withColumn("at", at)
    tag_at, size = F.when(F.col("tag"), F.col("at") - 1), F.col("size")
    sums = x.groupBy(key).agg(
        F.count("*").alias("token_n"), F.sum("at").alias("token_pos"), F.sum(F.col("at").cast("decimal(19,0)") * F.col("tid").cast("decimal(19,0)")).cast(wide).alias("token_check"),
        F.count(tag_at).alias("tag_n"), F.sum(tag_at).alias("tag_pos"), F.sum(tag_at * (-1 - F.col("speaker"))).cast(wide).alias("tag_check"),
        F.sum(size * (n - 1 - F.greatest(e, F.lit(-1)))).alias("audio_moved"), F.sum(size * (n - F.greatest(e, F.lit(0)))).alias("next_moved"),
    )
    row = lambda kind, n, pos, check: F.struct(F.lit(kind).alias("kind"), F.coalesce(n, F.lit(0)).cast("bigint").alias("n"), pos.cast("bigint").alias("pos_sum"), check.cast(wide).alias("check_sum"))
    chunks = F.greatest(n, F.lit(0))
    audio, sign = chunks * (chunks - 1) + F.coalesce("audio_moved", F.lit(0)), chunks * chunks + F.coalesce("next_moved", F.lit(0))
    rows = [row(kind, F.col(f"{kind}_n"), F.col(f"{kind}_pos"), F.col(f"{kind}_check")) for kind in ("token", "tag")]
    rows += [row(kind, chunks, pos, pos.cast(wide) * label) for kind, pos, label in (("audio", audio, -100), ("next", sign, -10))]
    whole = chunk_counts(length, key, chunk_ms).join(sums, key, "left")
    return whole.select(key, F.explode(F.array(*rows)).alias("x")).select(key, "x.*").where("n > 0")


def bad_utterances(utterances: DataFrame, tokens: DataFrame, max_same: int = 8, max_rate: float = 25) -> DataFrame:
    """utt_id, reason: empty, same_time or rate, in this order of precedence; others have none."""
    same = tokens.groupBy("utt_id", "end_ms").agg(F.count("*").alias("k")).groupBy("utt_id").agg(F.max("k").alias("same"), F.sum("k").alias("n"))
    x = utterances.select("utt_id", "s", "e").join(same, "utt_id", "left")
    rate = F.col("n") * 1000 > max_rate * F.greatest(F.col("e") - F.col("s"), F.lit(100))
    return x.select("utt_id", F.when(F.col("n").isNull(), "empty").when(F.col("same") > max_same, "same_time").when(rate, "rate").alias("reason")).where("reason is not null")


def token_ends(text: str, items: list[tuple[str, int]], tokens: list[tuple[int, int]]) -> list[int]:
    """End of each token, a stretch of ``text``: the latest end of the items that it overlaps, else the end of the token before, else 0.

    Items are looked for one after the other; one that isn't found counts where the last one ended.
    """
    spans, cur = [], 0
    for word, end in items:
        at = text.find(word, cur)
        at = cur if at < 0 else at
        cur = at + len(word)
        spans.append((at, cur, end))
    out: list[int] = []
    for a, b in tokens:
        over = [end for i, j, end in spans if i < b and j > a]
        out.append(max(over) if over else out[-1] if out else 0)
    return out


def token_char_span_align(rows: DataFrame, key: str) -> DataFrame:
    """Aligned items to ends of tokens: ``key`` (bigint), pos, end_ms.

    ``rows``: key, text, items array<struct<word, end_ms>> in order, tokens array<struct<a, b>>, character offsets of the tokens.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, text, items, tokens in b[["key", "text", "items", "tokens"]].itertuples(index=False):
                ends = token_ends(text, [(x["word"], int(x["end_ms"])) for x in items], [(x["a"], x["b"]) for x in tokens])
                out.extend((k, pos, end) for pos, end in enumerate(ends))
            yield pd.DataFrame(out, columns=["key", "pos", "end_ms"])

    x = rows.select(F.col(key).alias("key"), "text", "items", "tokens")
    return x.mapInPandas(run, "key bigint, pos int, end_ms bigint").withColumnRenamed("key", key)
