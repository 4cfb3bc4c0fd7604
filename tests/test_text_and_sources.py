import json
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions.text import normalize_text, word_edits
from colloquy.operators.interleave import token_char_span_align, token_ends
from colloquy.operators.scoring import match_events
from colloquy.operators.signal import channel_overlap_leak, log_mel
from colloquy.plans import text
from colloquy.sources import readers, sinks


def edits(a, b):
    row = list(range(len(a) + 1))
    for k, y in enumerate(b, 1):
        new = [k]
        for i, x in enumerate(a, 1):
            new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + (x != y)))
        row = new
    return row[-1]


def test_word_edits(spark):
    r = random.Random(1)
    pairs = [([r.choice("abc") for _ in range(r.randrange(6))], [r.choice("abc") for _ in range(r.randrange(6))]) for _ in range(60)]
    df = spark.createDataFrame(pairs, "r array<string>, h array<string>")
    assert [x.k for x in df.select(word_edits(F.col("r"), F.col("h")).alias("k")).collect()] == [edits(a, b) for a, b in pairs]


def test_normalize(spark):
    df = spark.createDataFrame([("<b>Ｈi</b>,  THERE!", "en"), ("안녕 하세요.", "ko"), (None, "en"), ("", "en")], "t string, l string")
    assert [x.n for x in df.select(normalize_text(F.col("t"), F.col("l")).alias("n")).collect()] == ["hi there", "안녕하세요", None, ""]


def test_readers(spark, tmp_path):
    d = tmp_path / "conv7"
    d.mkdir()
    (d / "speaker_1_annotation_a.srt").write_text("1\n00:00:01,200 --> 00:00:03,450\n[Normal Turn] one\ntwo\n\n2\nno time\nx\n\n3\n00:01:00,000 --> 00:01:01,000\nplain\n")
    got = readers.read_srt(spark, str(tmp_path)).orderBy("start_s").collect()
    assert [(x.conv_id, x.speaker, x.start_s, x.end_s, x.label, x.text) for x in got] == [("oto-conv7", 0, 1.2, 3.45, "Normal Turn", "one two"), ("oto-conv7", 0, 60.0, 61.0, "", "plain")]
    (tmp_path / "x.json").write_text(json.dumps({"File": {"FileName": "x.wav"}, "ConversationInfo": {"Domain": "food"}, "Conversation": [{"SpeakerNo": "S1", "StartTime": "1,003.24", "EndTime": "1,004", "Text": " hi ", "SpeakerEmotionCategory": "Calm"}, {"SpeakerNo": "S2", "StartTime": "bad", "EndTime": "2", "Text": None}]}))
    got = readers.read_conversation_json(spark, str(tmp_path)).orderBy("speaker").collect()
    assert [(x.conv_id, x.speaker, x.start_s, x.text) for x in got] == [("x", 0, 1003.24, "hi"), ("x", 1, None, None)]
    (tmp_path / "a.jsonl").write_text('{"speaker":0,"start":1.0,"end":2.0,"text":"a","tokens":[{"id":5,"text":"a","end_time":1.5}]}\n\n{"speaker":\n\x00\n')
    lines = spark.read.text(str(tmp_path / "a.jsonl"))
    assert readers.parse_jsonl(lines, "value", readers.ALIGNMENT).count() == 1
    aligned = readers.read_alignments(spark, str(tmp_path / "a.jsonl")).first()
    assert (aligned.conv_id, aligned.text, aligned.tokens[0].end_time) == ("a", "a", 1.5)
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes((np.sin(np.arange(16000) / 5) * 20000).astype("<i2").tobytes())
    audio = readers.read_wav(spark, str(tmp_path)).withColumn("samples", F.element_at("samples", 1))
    mel = log_mel(audio, "path", "samples").collect()
    assert len(mel) == 50 and len(mel[0].mel) == 80
    fm = readers.front_matter(spark.createDataFrame([("---\ntitle: a: b\nowner: me\n---\nbody",)], "t string"), "t")
    assert fm.first().fields == {"title": "a: b", "owner": "me"}
    snap = spark.createDataFrame([("s1", "a", 1), ("s2", "a", 2), ("s2", "a", 2), ("s2", "b", 3)], "snap string, k string, v int")
    assert sorted(x.k for x in readers.latest_snapshot(snap, "snap", "k").collect()) == ["a", "b"]


def tone(path, channels, rate=48_000, seconds=3.0, bits=2):
    """A file with a tone in the given stretches (channel, from, to) and faint noise elsewhere."""
    n = int(rate * seconds)
    x = np.random.default_rng(1).normal(0, 1e-4, (n, len(channels)))
    for c, spans in enumerate(channels):
        for a, b in spans:
            i, j = int(a * rate), int(b * rate)
            x[i:j, c] += 0.5 * np.sin(np.arange(j - i) * 2 * np.pi * 220 / rate)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(len(channels)), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())


def test_stereo_corpus(spark, tmp_path):
    for k in (2, 10):
        tone(tmp_path / f"c{k}.wav", [[(1.0, 2.0)], [(0.2, 0.7)]])
    said = [{"SpeakerNo": "S1", "StartTime": "0.2", "EndTime": "0.7", "Text": "a", "SpeakerEmotionCategory": "Calm"}, {"SpeakerNo": "S2", "StartTime": "1.0", "EndTime": "2.0", "Text": "b"}]
    (tmp_path / "c2.json").write_text(json.dumps({"File": {"FileName": "c2.wav"}, "ConversationInfo": {"Domain": "food"}, "Conversation": said}))
    (tmp_path / "broken.wav").write_bytes(b"RIFF....")
    got = readers.read_corpus(spark, "stereo", str(tmp_path))
    c = {x.conv_id: x for x in got.conversations.collect()}
    assert sorted(c) == ["c10", "c2"] and c["c2"].duration == 3.0 and c["c2"].meta["speaker_channel_swapped"] == "true" and c["c10"].meta["speaker_channel_swapped"] == "false"
    assert sorted((x.speaker, x.text) for x in got.utterances.collect()) == [(0, "b"), (1, "a")]  # the first speaker's words lie on the second channel
    seg = sorted((x.conv_id, x.speaker, x.i, x.j) for x in got.segments.collect())
    assert [(a, b) for a, b, _, _ in seg] == [("c10", 0), ("c10", 1), ("c2", 0), ("c2", 1)] and all(abs(i - w) <= 1 for (_, s, i, _), w in zip(seg, (50, 10, 50, 10), strict=True))
    assert [x.conv_id for x in readers.read_corpus(spark, "stereo", str(tmp_path), limit=1).conversations.collect()] == ["c2"]  # numbers by value
    assert readers.read_corpus(spark, "stereo", str(tmp_path), only=["c10"]).utterances.count() == 0
    with pytest.raises(ValueError, match="no corpus"):
        readers.read_corpus(spark, "other", str(tmp_path))
    audio = readers.read_wav(spark, str(tmp_path), 16_000)
    assert [x.path.rsplit("/", 1)[1] for x in readers.bad_files(audio).collect()] == ["broken.wav"]
    x = audio.where("stem = 'c2'").select("sr", "samples", readers.audio_window(F.col("samples"), F.col("sr"), F.lit(2.5), 16_000).alias("w")).first()
    assert x.sr == 16_000 and [len(y) for y in x.samples] == [48_000, 48_000] and [len(y) for y in x.w] == [16_000, 16_000] and set(x.w[0][8_000:]) == {0.0}
    assert max(x.samples[0][20_000:30_000]) == pytest.approx(0.5, abs=0.02)
    copies = sinks.write_wav_copy(audio, str(tmp_path / "copies"))
    assert copies.count() == 2 and readers.decoded(copies.first().content)[1].shape == (2, 48_000)


def test_directory_corpus(spark, tmp_path):
    for name, meta in (("7", {"task_id": "77", "noise": "car"}), ("8", {"noise": "none"})):
        d = tmp_path / name
        d.mkdir()
        (d / "metadata.json").write_text(json.dumps(meta))
        (d / "speaker_1_annotation_a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\n[Normal Turn] one\n\n2\n00:00:01,500 --> 00:00:02,500\n[Laughter] two\n")
        (d / "speaker_2_annotation_a.srt").write_text("1\n00:00:03,000 --> 00:00:04,000\n[Channel Bleed] x\n")
    tone(tmp_path / "8" / "speaker_1_audio.wav", [[]], 16_000, 5.0)
    tone(tmp_path / "8" / "speaker_2_audio.wav", [[]], 8_000, 4.0)
    x = readers.read_audio(spark, "otoSpeech", str(tmp_path)).first()
    assert (x.conv_id, x.sr, [len(c) for c in x.samples]) == ("oto-8", 16_000, [64_000, 64_000])
    with pytest.raises(ValueError, match="no source"):
        readers.read_audio(spark, "other", str(tmp_path))
    got = readers.read_corpus(spark, "otoSpeech", str(tmp_path))
    assert sorted((x.conv_id, x.duration, x.meta["noise"]) for x in got.conversations.collect()) == [("oto-77", 4.0, "car"), ("oto-8", 5.0, "none")]
    assert got.utterances.count() == 6
    assert sorted((x.conv_id, x.speaker, x.i, x.j) for x in got.segments.collect()) == [("oto-77", 0, 50, 125), ("oto-8", 0, 50, 125)]


def test_summaries_and_documents(spark, tmp_path):
    path = str(tmp_path / "stats")
    sinks.write_json_summary(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v bigint"), path)
    sinks.merge_json_summary(spark.createDataFrame([("b", 3), ("c", 4)], "k string, v bigint"), path, "k")
    assert sorted((x.k, x.v) for x in spark.read.json(path).collect()) == [("a", 1), ("b", 3), ("c", 4)]
    events = spark.createDataFrame([("c", 0, "eot", 2.5), ("c", 0, "eot", 1.0), ("c", 1, "int", 3.0)], "conv_id string, speaker int, task string, at double")
    doc = json.loads(sinks.predictions_document(events).first().value)
    assert doc == {"conversation_id": "c", "speaker_1": {"eot": [1.0, 2.5], "interruption": []}, "speaker_2": {"eot": [], "interruption": [3.0]}}
    pages = [("---\ntitle: t1\nowner: me\nstatus: open\n---",), ("---\ntitle: t2\nowner: me\nstatus: doing\npriority: p1\n---",), ("---\ntitle: t3\nstatus: done\n---",)]
    board = readers.dashboard(readers.front_matter(spark.createDataFrame(pages, "t string"), "t"))
    assert [tuple(x) for x in board.collect()] == [("me", "p1", "9999", "t2"), ("me", "p9", "9999", "t1")]


def test_decoder_and_late_tokens(spark):
    from colloquy.streaming.clock import ChunkDecoder, decode_chunks, drain, emit_tokens, staged

    d = ChunkDecoder(2, 0.5, blocked=frozenset({9}))
    offered = [(5, 3.0), (-2, 2.9), (9, 10.0), (6, 2.0), (7, 1.9), (8, 0.4)]
    got = d.chunk(lambda taken: ([p for p in offered if p[0] not in taken], 1.0))
    assert (got, d.speaker, d.forced) == ([(5, 0), (6, 1)], 1, 1)
    assert d.chunk(lambda taken: ([(8, 0.4)], 1.0)) == [] and d.chunk(lambda taken: ([(8, 0.6)] if not taken else [], 1.0)) == [(8, 1)]
    rows = [("c", 1, 0, 100, "2025-01-01 00:00:00.1"), ("c", 2, 1, 120, "2025-01-01 00:00:00.12"), ("c", 3, 0, 5000, "2025-01-01 00:00:05"), ("d", 4, 1, 40, "2025-01-01 00:00:00.04")]
    tokens = spark.createDataFrame(rows, "conv_id string, tid bigint, speaker int, end_ms bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    out = {x.tid: (x.e, x.tag, x.flushed) for x in drain(emit_tokens(staged(tokens, "ts", "2025-02-01 00:00:00", 2), 1)).collect()}
    assert {k: v[:2] for k, v in out.items()} == {1: (3, True), 2: (4, True), 3: (64, True), 4: (2, True)} and out[3][2] and out[4][2]
    chunks = spark.createDataFrame([("c", 1, 0.0, [(5, 1.0)], 1), ("c", 2, 0.0, [(-2, 1.0), (6, 0.5)], 2), ("c", 3, 0.0, [(7, 1.0)], 3)], "conv_id string, chunk bigint, stop double, candidates array<struct<token bigint, score double>>, ts bigint")
    chunks = chunks.withColumn("ts", F.timestamp_seconds("ts"))
    assert sorted((x.chunk, x.token, x.speaker) for x in drain(decode_chunks(staged(chunks, "ts", "2025-02-01 00:00:00", 3))).collect()) == [(1, 5, 0), (2, 6, 1), (3, 7, 1)]


def test_benchmark_parquet(spark, tmp_path):
    df = spark.sql("select 'c' conversation_id, array(named_struct('start_s', 1d, 'end_s', 2d, 'text', 't', 'label', 'l')) speaker_1_annotation_a, array(named_struct('start_s', 3d, 'end_s', 4d, 'text', 'u', 'label', 'm')) speaker_2_annotation_a")
    df.write.parquet(str(tmp_path / "b"))
    assert sorted(tuple(x) for x in readers.read_benchmark(spark, str(tmp_path / "b")).collect()) == [("c", 0, 1.0, 2.0, "t", "l"), ("c", 1, 3.0, 4.0, "u", "m")]


def test_benchmark_audio_of_some(spark, tmp_path):
    df = spark.sql("select id conversation_id, named_struct('bytes', cast('a' as binary)) speaker_1_audio, named_struct('bytes', cast(null as binary)) speaker_2_audio from values ('c'), ('d') t(id)")
    df.write.parquet(str(tmp_path / "s" / "data"))
    assert sorted((x.conv_id, x.speaker, x.content) for x in readers.benchmark_audio(spark, str(tmp_path), ["tb-d"]).collect()) == [("tb-d", 0, b"a"), ("tb-d", 1, None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "m"), (2, "n")], "id int, man string")
    path = str(tmp_path / "f")
    assert sinks.append_missing(df, path, "id").count() == 2
    assert sinks.append_missing(spark.createDataFrame([(2, "n"), (3, "n")], "id int, man string"), path, "id").count() == 3
    sinks.write_partitioned(df, str(tmp_path / "p"), "man")
    sinks.write_partitioned(spark.createDataFrame([(9, "m")], "id int, man string"), str(tmp_path / "p"), "man")
    assert sorted(x.id for x in spark.read.parquet(str(tmp_path / "p")).collect()) == [2, 9]
    probs = spark.createDataFrame([("c", 0, 1, 0.5), ("c", 0, 0, 0.25), ("c", 1, 0, 1.0)], "conv_id string, speaker int, f int, p double")
    assert json.loads(sinks.probabilities_document(probs, "eot", 50.0).first().value)["speaker_1"]["prob"] == [0.25, 0.5]
    runs = spark.createDataFrame([("r", 1, 0.3), ("r", 2, 0.1), ("r", 3, 0.2)], "run string, step int, loss double")
    assert sorted(x.step for x in sinks.keep_best_and_last(runs, "run", "step", "loss").collect()) == [2, 3]


def test_match_events(spark):
    r = random.Random(2)
    gold = [("k", r.randrange(5000)) for _ in range(80)]
    pred = [("k", r.randrange(5000)) for _ in range(80)]
    got = sorted((x["at"], x.hit) for x in match_events(spark.createDataFrame(gold, "k string, at bigint"), spark.createDataFrame(pred, "k string, at bigint"), ["k"], 12, 150).collect())
    free, want = sorted(p for _, p in pred), []
    for t in sorted(g for _, g in gold):
        hit = next((p for p in free if t - 12 <= p <= t + 150), None)
        if hit is not None:
            free.remove(hit)
        want.append((t, hit))
    assert got == sorted(want, key=lambda x: (x[0], x[1] is None, x[1] or 0)) or sorted(got, key=repr) == sorted(want, key=repr)


def test_pairs_of_any_writing(spark, tmp_path, rows):
    said = [(1, "c", 0, 1.0, 2.0, "Ｓí, señor."), (2, "c", 1, 3.0, 4.0, "안녕 하세요."), (3, "c", 0, 1007.229, 1008.0, "one two"), (4, "c", 0, 5.0, 6.0, "plain one"), (5, "c", 1, 7.0, 8.0, None)]
    spark.createDataFrame([(*x, None) for x in said], "utt_id bigint, conv_id string, speaker int, start_s double, end_s double, text string, label string").write.parquet(str(tmp_path / "utterance.parquet"))
    lines = [(11, "c", "sí señor", "00:00:01.000"), (12, "c", "안녕하세요", "3.00"), (13, "c", "one too", "1,007.229"), (14, "c", "plain one", "00:00:05,000"), (15, "c", "no text there", "7.0"), (16, "c", None, "5.0"), (17, "c", "no time", None)]
    spark.createDataFrame(lines + lines[:1], "raw_id bigint, conv_id string, text string, start_time string").write.parquet(str(tmp_path / "raw_utterance.parquet"))
    d = str(tmp_path)
    assert rows(text.wer(spark, d)) == [(1, 11, 0, 2), (2, 12, 2, 2), (3, 13, 1, 2), (4, 14, 0, 2)]
    assert rows(text.pooled_error(spark, d)) == [(False, 25, 0.04, 0.04), (True, 6, 0.166667, 0.166667)]  # the space between two lines counts
    assert rows(text.baseline_errors(spark, d)) == [("c", s, ko, n, k, m, round(k / m, 6)) for s in ("as delivered", "without brackets") for ko, n, k, m in ((False, 3, 1, 6), (True, 1, 0, 5))]
    assert rows(text.cer_all(spark, d)) == [(0, 3, 1, 24, 0.041667), (1, 1, 0, 5, 0.0)]
    assert {(x.utt_id, x.raw_id, x.pos) for x in text.token_latency(spark, d).collect()} == {(1, 11, 0), (1, 11, 1), (3, 13, 0), (4, 14, 0), (4, 14, 1)}


def test_normalize_all_takes_every_document(spark, tmp_path, rows):
    documents = [(1, "Plain, TEXT", "en"), (2, "Ｓí,　SEÑOR.", "es"), (3, "안녕 하세요.", "ko"), (4, "", None), (5, None, "en")]
    spark.createDataFrame(documents, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(text.normalize_all(spark, str(tmp_path))) == [(1, "plain text"), (2, "sí señor"), (3, "안녕하세요"), (4, ""), (5, None)]


def test_channel_overlap_leak(spark):
    loud, soft = [1.0, -1.0], [0.0001, 0.0001]
    frames = [("x", f, loud if f < 15 else soft, loud if f in (0, 1) or f > 17 else soft) for f in range(20)] + [("y", f, loud, loud if f > 9 else soft) for f in range(12)]
    got = {x.k: x for x in channel_overlap_leak(spark.createDataFrame(frames, "k string, f int, a array<double>, b array<double>"), ["k"], first=2).collect()}
    x, y = got["x"], got["y"]
    assert abs(x.leak + 10 * np.log10(1 / (1e-8 + 1e-10) * (1 + 1e-10))) < 1e-6 and y.leak is None and y.corr is None  # ten frames are too few
    assert abs(x.corr - 1) < 1e-9 and (x.overlap, x.ratio_a, x.ratio_b) == (2 / 17, 0.75, 0.2)


def test_token_char_span_align(spark, rows):
    items = [("ab", 100), ("nowhere", 200), ("cd", 300)]
    assert token_ends("..ab cd", [("ab", 100), ("cd", 300)], [(0, 1), (1, 3), (3, 6), (4, 5), (5, 7)]) == [0, 100, 300, 300, 300]
    df = spark.createDataFrame([(7, "ab cd", items, [(0, 2), (2, 3), (3, 5)])], "u bigint, text string, items array<struct<word string, end_ms bigint>>, tokens array<struct<a int, b int>>")
    assert rows(token_char_span_align(df, "u")) == [(7, 0, 100), (7, 1, 200), (7, 2, 200)]
