"""Queries of this subpackage over the data set, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import sql
from colloquy.llm.byte_pairs import encode_texts
from colloquy.llm.chunking import cut_items, quiet_ends
from colloquy.llm.identity import id_key, participant_id
from colloquy.llm.mixture import mix, records, shares, verified
from colloquy.llm.nearest import match_nearest
from colloquy.llm.packing import fill_report, pack
from colloquy.llm.shared_spans import SharedSpans
from colloquy.llm.splits import assign_splits, components
from colloquy.llm.transcript import caption_lines, participants, speaker_turns
from colloquy.llm.visual_form import look_alike_pairs
from colloquy.tables import checkpointed, millis, table, usable_utterances


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances of one conversation that look the same but are written differently."""
    pairs = look_alike_pairs(table(spark, sf_dir, "utterance"), "conv_id", "utt_id", "text")
    return pairs.select(F.col("a").alias("utt_id_a"), F.col("b").alias("utt_id_b"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 120 s of the longer conversations, with 10 s in common."""
    whole = table(spark, sf_dir, "conversation").select(F.col("id").alias("conv_id"), millis("duration").alias("total"))
    marks = quiet_ends(usable_utterances(table(spark, sf_dir, "utterance")), "conv_id", "start_ms", "end_ms").withColumn("strength", F.lit(1.0))
    pieces = cut_items(whole, marks, "conv_id", "total", "at", "strength", 120_000, 10_000)
    return pieces.withColumnsRenamed({"start": "start_ms", "end": "end_ms"})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The voice-activity segment nearest to each usable utterance of speaker 0 or 1."""
    middle = (F.col("start_ms") + F.col("end_ms")).alias("middle2")
    said = usable_utterances(table(spark, sf_dir, "utterance"), "speaker", "utt_id").where(F.col("speaker").isin(0, 1)).select("conv_id", "speaker", "utt_id", middle)
    heard = table(spark, sf_dir, "vad_segment").select("conv_id", "speaker", "seg_id", millis("start_s").alias("start_ms"), millis("end_s").alias("end_ms"))
    heard = heard.select("conv_id", "speaker", "seg_id", middle)
    return match_nearest(said, heard, ["conv_id", "speaker"], "utt_id", "seg_id", "middle2", "middle2", 800)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the raw lines of each conversation."""
    forms = [r["form"] for r in table(spark, sf_dir, "filler_item").select("form").collect()]  # fixed: 15 rows
    return speaker_turns(table(spark, sf_dir, "raw_utterance"), participants(table(spark, sf_dir, "conversation")), forms)


def p5_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the transcripts among the documents: doc_id, speaker (0 or 1), first and last line, n_words. Who is named first is speaker 0; a third name belongs to neither."""
    forms = [r["form"] for r in table(spark, sf_dir, "filler_item").select("form").collect()]  # fixed: 15 rows
    lines = caption_lines(table(spark, sf_dir, "documents").select("doc_id", "text").where("doc_id is not null"), "doc_id", "text")
    numbered = F.when(F.col("speaker_no") < 2, (F.col("speaker_no") + 1).cast("string"))
    rows = lines.select(F.col("doc_id").cast("string").alias("conv_id"), F.col("line_no").alias("raw_id"), numbered.alias("speaker"), F.coalesce("start_time", F.col("line_no").cast("string")).alias("start_time"), F.lit(None).cast("string").alias("label"), "text")
    nobody = rows.select("conv_id", F.lit(None).cast("string").alias("spk1"), F.lit(None).cast("string").alias("spk2")).limit(0)
    turns = speaker_turns(rows, nobody, forms)
    return turns.select(F.col("conv_id").cast("bigint").alias("doc_id"), "speaker", F.col("first_raw_id").alias("first_line"), F.col("last_raw_id").alias("last_line"), "n_words")


def conversation_groups(conversation: DataFrame, utterance: DataFrame) -> DataFrame:
    """conv_id, group_id: conversations tied by a participant, a recording or a derivation."""
    conv = lambda c: F.concat(F.lit("c|"), F.coalesce(id_key(c), F.concat(F.lit("="), c)))
    node = conv(F.col("id"))
    meta = lambda k: F.col("meta")[k]
    named = conversation.where("id is not null")
    tied = F.array(
        *(F.concat(F.lit("p|"), participant_id(meta(k))) for k in ("spk1", "spk2")), F.concat(F.lit("r|"), id_key(meta("recording"))), F.concat(F.lit("c|"), id_key(meta("derived_from")))
    )
    by_meta = named.select(node.alias("a"), F.explode(tied).alias("b"))
    voices = checkpointed(utterance.where("conv_id is not null").select("conv_id", "speaker_id").distinct())  # so that ids are parsed once a pair, not once a row
    by_voice = voices.select(conv(F.col("conv_id")).alias("a"), F.concat(F.lit("p|"), participant_id(F.col("speaker_id"))).alias("b"))
    itself = named.select(node.alias("a"), node.alias("b"))
    links = checkpointed(by_meta.union(by_voice).where("b is not null").union(itself).distinct())
    labels = checkpointed(components(links))
    ids = named.select(F.col("id").alias("conv_id"), node.alias("node")).distinct().join(labels, "node").select("conv_id", "root")
    people = labels.where("node like 'p|%'").select(F.expr("substring(node, 3)").alias("name"), "root")
    names = ids.select(F.col("conv_id").alias("name"), "root").union(people).groupBy("root").agg(F.min("name").alias("group_id"))
    return ids.join(names, "root").select("conv_id", "group_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every conversation."""
    return conversation_groups(table(spark, sf_dir, "conversation"), table(spark, sf_dir, "utterance"))


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every conversation, groups kept together."""
    targets = [(r["split"], r["share_pct"]) for r in table(spark, sf_dir, "split_target").orderBy(F.desc("share_pct"), "split").collect()]  # fixed: 3 rows
    return assign_splits(p6_found(spark, sf_dir), "group_id", targets)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversation = table(spark, sf_dir, "conversation").select("id", "source", millis("duration").alias("ms"))
    return records(conversation, "id", "source", "ms", table(spark, sf_dir, "mix_target"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix goes through each source, and whether that is too little, held against the mix itself."""
    rows, targets = checkpointed(_records(spark, sf_dir)), table(spark, sf_dir, "mix_target")
    return verified(rows, targets, mix(rows, targets))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix, a row for each time a conversation comes out."""
    return mix(_records(spark, sf_dir), table(spark, sf_dir, "mix_target"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the mix reaches."""
    rows, targets = checkpointed(_records(spark, sf_dir)), table(spark, sf_dir, "mix_target")
    return shares(rows, mix(rows, targets), targets)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


def p9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in containers of 2,048 tokens."""
    sizes = checkpointed(p8_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("n_tokens")))
    return pack(sizes, "doc_id", "n_tokens", 2048)


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of p9_pack are, and how many there must be at least."""
    return fill_report(p9_pack(spark, sf_dir), 2048, 512, 2048)


def p9_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as examples to train answers on, in containers of 2,048 tokens, 8 segments and 1,024 tokens that bear loss.

    Of a document with lines of ``Speaker 2:`` those lines bear loss (their part of the characters, as a part of the tokens), of others all of it.
    """
    answers = F.array_join(F.regexp_extract_all("text", F.lit(r"(?m)^Speaker 2:.*$"), F.lit(0)), "\n")
    sizes = encode_texts(table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), F.length(answers).alias("k"), "text"), "text")
    loss = F.when(F.col("k") > 0, F.ceil(F.size("ids") * F.col("k") / F.col("n"))).otherwise(F.size("ids"))
    sizes = checkpointed(sizes.select("doc_id", F.size("ids").alias("n_tokens"), loss.alias("n_loss")))
    return pack(sizes, "doc_id", "n_tokens", 2048, 8, "n_loss", 1024)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that have 240 consecutive characters in common."""
    pairs = SharedSpans(table(spark, sf_dir, "documents"), "doc_id", "text").pairs()
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many characters of each document stand in passages that another document has too."""
    rows = SharedSpans(table(spark, sf_dir, "documents"), "doc_id", "text").shared_characters()
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_chars"), F.col("shared").alias("n_shared"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p5_found": p5_found, "p5_documents": p5_documents, "p6_found": p6_found, "p6_splits": p6_splits, "p7_found": p7_found, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_ids": p8_ids, "p9_pack": p9_pack, "p9_fill": p9_fill, "p9_dialogues": p9_dialogues, "p10_found": p10_found, "p10_shared": p10_shared}
SQL = sql.SQL
