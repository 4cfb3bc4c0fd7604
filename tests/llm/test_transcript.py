import random

import pytest
from pyspark.sql import functions as F

from colloquy.llm.transcript import LineParser, caption_lines, captions, clock_ms, fillers, parse_line, speaker_turns

FORMS = ["um", "uh", "er", "erm", "hmm", "eh", "mmm", "음", "으음", "어"]
FILLER = fillers(FORMS)


@pytest.mark.parametrize(
    ("speaker", "label", "text", "want"),
    [
        ("Speaker One", None, "Hi there", (0, None, False, 2)), ("화자2", "Happy", "네.", (1, None, False, 1)), ("Ｓ１", None, "x", (0, None, False, 1)), ("spk b", None, "x", (1, None, False, 1)), (" S1", None, "x", (0, None, False, 1)),
        ("P-0000052", None, "x", (None, "P0000052", False, 1)), ("P1", None, "x", (None, "P0000001", False, 1)), (None, None, "[S2] Oh nice.", (1, None, False, 2)), ("", None, "(B) ¿De verdad?", (1, None, False, 2)),
        (None, None, "00:00:45,059 --> SPEAKER_2：Well, um - it's 10:30.", (1, None, False, 4)), (None, None, "{t=46} [Normal_Turn] 화자1: ok", (0, None, False, 1)), (None, None, "A las 10:30", (None, None, False, 4)),
        ("1", "NON-SPEECH NOISE", "wind", (0, None, True, 1)), ("1", None, "[Channel_Bleed] yes", (0, None, True, 1)), ("2", None, "Ummm... 음~ 어어 uhuh", (1, None, False, 0)), ("2", None, "((unclear)) *sighs* <9.9s> 【박수】", (1, None, False, 0)),
        (None, None, None, (None, None, False, 0)), ("2", None, "l'entrée costs 57.29, isn't it", (1, None, False, 6)), ("??", None, "umbrella", (None, None, False, 1)), (None, None, "P0000007: hello", (None, "P0000007", False, 1)),
        (None, None, "00:01.000 --> 00:04.000 hello there", (None, None, False, 2)), (None, None, "12\n00:00:01,000 --> 00:00:04,000\nyes", (None, None, False, 1)), (None, None, "<v Speaker 1>Hi</v>", (0, None, False, 1)),
        (None, None, "00:01.000 --> 00:04.000 align:start position:0%\n<v.loud Speaker B>Hi", (1, None, False, 1)), (None, None, "*CHI: more juice", (None, None, False, 2)), (None, None, "*SP2:\tmore juice \x15100_900\x15", (1, None, False, 2)),
        (None, None, "%mor: n|juice", (None, None, False, 0)), ("1", None, "a > b is true", (0, None, False, 4)), (None, None, "a > b is true", (None, None, False, 4)), (None, None, "A> true", (0, None, False, 1)), (None, "", "*sighs* yes", (None, None, False, 1)),
    ],
)
def test_lines(speaker, label, text, want):
    assert parse_line(speaker, label, text, FILLER) == want


def test_clock(spark):
    cases = {"00:01:04.920": 64920, "00:00:45,059": 45059, "1,037.04": 1037040, "9.5": 9500, "12": 12000, "01:02": 62000, "1,007.229": 1007229, "x": None, "": None, None: None, "329.034": 329034}
    df = spark.createDataFrame(list(cases.items()), "t string, want bigint")
    assert [(x.t, x.got) for x in df.select("t", clock_ms(F.col("t")).alias("got")).collect()] == list(cases.items())


def plain_turns(lines, people):
    out = []
    for conv in sorted({x[0] for x in lines}):
        last, turns = None, []
        for c, i, sp, at, lab, text in sorted({x for x in lines if x[0] == conv}, key=lambda x: (float(x[3]), x[1])):
            n, p, noise, words = parse_line(sp, lab, text, FILLER)
            if n is None and p:
                n = {people[c][0]: 0, people[c][1]: 1}.get(p) if c in people else None
            last = n if n is not None else last
            if noise or not words or last is None:
                continue
            if turns and turns[-1][0] == last:
                turns[-1][2], turns[-1][3] = i, turns[-1][3] + words
            else:
                turns.append([last, i, i, words])
        out += [(conv, *t) for t in turns]
    return sorted(out)


@pytest.mark.parametrize("batch", [10000, 3])
def test_turns(spark, batch):
    r = random.Random(6)
    lines = []
    for conv, n in (("hot", 900), ("a", 40), ("b", 1), ("c", 25), ("quiet", 6)):
        for k in range(n):
            sp = r.choice([None, None, "", "S1", "speaker two", "P0000001", "P0000002", "P0000099"])
            text = r.choice(["hello there", "um", "[laughter]", "yes", "(B) ok", "one two three"])
            if conv == "quiet":
                sp, text = None, "nobody named"
            lines.append((conv, 1000 + k, sp, f"{r.randrange(0, 400)}.{r.randrange(1000):03d}", r.choice([None, "Happy", "channel bleed"]), text))
    people = {"hot": ("P0000001", "P0000002"), "a": ("P0000002", None), "b": (None, None)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame([*lines, *lines[:50], (None, 1, "S1", "1", None, "x")], "conv_id string, raw_id bigint, speaker string, start_time string, label string, text string")
        who = spark.createDataFrame([(c, *p) for c, p in people.items()], "conv_id string, spk1 string, spk2 string")
        got = sorted((x.conv_id, x.speaker, x.first_raw_id, x.last_raw_id, x.n_words) for x in speaker_turns(df, who, FORMS).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == plain_turns(lines, people)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id string, raw_id bigint, speaker string, start_time string, label string, text string")
    who = spark.createDataFrame([], "conv_id string, spk1 string, spk2 string")
    assert speaker_turns(df, who, []).count() == 0


def test_lines_together_as_alone():
    speakers, labels = [None, "S1", "spk b", "P12", "\0", ""], [None, "Channel-Bleed", "Happy"]
    texts = [None, "", "A: um, ok", "\u0301x", "[S2] (laughs) no", "a\0b", "ｅｒｍ", "x" * 50_000]
    rows = [(s, label, t) for s in speakers for label in labels for t in texts]
    assert list(LineParser(FILLER).lines(*map(list, zip(*rows, strict=True)))) == [parse_line(*r, FILLER) for r in rows]


def test_layouts(spark):
    srt = "1\n00:00:01,000 --> 00:00:04,000\nSpeaker 1: hi\nthere\n\n2\n00:00:05,000 --> 00:00:06,000\n[laughs]\n"
    vtt = "WEBVTT - x\n\nNOTE hidden\nstill\n\nintro\n00:01.000 --> 00:04.000 align:start\n<v Ann>Hello\n<v Bob>Hi\n"
    chat = "@Begin\n*CHI:\tmore juice .\n\tplease \x15100_900\x15\n%mor:\tqn|more\n\tn|juice\n*MOT: no\n@End"
    named = "Dr. Who: it's 10:30\r\nAnn: yes\r\n\r\nwhy?\r\nann: no"
    assert captions(srt) == [[None, "00:00:01,000", "00:00:04,000", "Speaker 1: hi there"], [None, "00:00:05,000", "00:00:06,000", "[laughs]"]]
    assert captions(vtt) == [["Ann", "00:01.000", "00:04.000", "Hello"], ["Bob", "00:01.000", "00:04.000", "Hi"]]
    assert captions(chat) == [["CHI", "0.100", "0.900", "more juice . please"], ["MOT", None, None, "no"]]
    assert captions(named) == [["Dr. Who", None, None, "it's 10:30"], ["Ann", None, None, "yes"], [None, None, None, "why?"], ["ann", None, None, "no"]]
    files = spark.createDataFrame([(1, named, 0), (2, None, 0), (3, " \n", 0), (4, vtt, 0)], "id int, text string, key int")
    got = sorted((x.id, x.line_no, x.speaker_no) for x in caption_lines(files, "id", "text").collect())
    assert got == [(1, 0, 0), (1, 1, 1), (1, 2, None), (1, 3, 1), (4, 0, 0), (4, 1, 1)]
    assert caption_lines(files.where("false"), "id", "text").count() == 0
