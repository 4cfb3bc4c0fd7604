import random
import unicodedata

import pyarrow as pa

from colloquy.llm.visual_form import LOOK_ALIKE, SHOWS_NOTHING, look_alike_pairs, visual_array, with_visual_form


def plain(s):
    """The form of one text, sign by sign."""
    if s is None:
        return None
    hidden = lambda c: any(a <= ord(c) <= b for a, b in SHOWS_NOTHING)
    out = []
    for c in s:
        if hidden(c):
            continue
        kind = unicodedata.decomposition(c).split(" ")[0]
        if kind in ("<wide>", "<narrow>", "<noBreak>"):
            c = unicodedata.normalize("NFKC", c)
        if c in "ﬁﬂﬀﬃﬄ":
            c = unicodedata.normalize("NFKC", c)
        for x in unicodedata.normalize("NFD", c):
            out.append(LOOK_ALIKE.get(x, " " if x.isspace() else x))
    return unicodedata.normalize("NFC", " ".join("".join(out).split()))


def test_against_plain_version():
    r = random.Random(1)
    signs = "aeiouncsAEOxp ' - 12" + "̧̣́̈" + "éñçüệ" + "ｗｅＡ１！" + "аеорсухіѕ" + "ΑΒΕο" + "​­﻿⁠" + " 　 \t\n" + "한국어각" + "한" + "①²…‑ﬁΩмир😀"
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(25))) for _ in range(4000)] + [None, "", "   ", "​"]
    assert visual_array(pa.array(texts)).to_pylist() == [plain(t) for t in texts]


def test_kept_apart():
    kept = ["x²", "x2", "①0", "10", "cafe", "café", "Cafe", "a.", "a,", "ı", "i", "ι", "ꭰ", "D", "d", "ꭱ"]
    assert len(set(visual_array(pa.array(kept)).to_pylist())) == len(kept)


def test_brought_together():
    alike = {"Ⅻ": "XII", "ⅼ": "l", "ραυ": "pau", "ꮪꮯ": "sc", "ꭰ": "ᴅ", "a\x07b\x00": "ab", "é\x7f x": "é x", "\x07": "", "г": "r"}
    assert visual_array(pa.array(list(alike))).to_pylist() == list(alike.values())
    assert visual_array(pa.array(["a\x07b", "\x01 \t x"])).to_pylist() == ["ab", "x"]


def test_slices_long_texts_and_extra_columns(spark):
    long = "ａ́ " * 200_000
    assert visual_array(pa.array(["x", long, "y"]).slice(1, 1)).to_pylist() == [("á " * 200_000).strip()]
    df = spark.createDataFrame([(1, "ｘ", "old"), (2, None, None)], "id int, text string, visual_form string")
    assert [tuple(x) for x in with_visual_form(df, "text").orderBy("id").collect()] == [(1, "ｘ", "x"), (2, None, None)]


def test_pairs(spark):
    rows = [
        ("c", 1, "Yes."), ("c", 2, "Ｙes."), ("c", 3, "Yes."), ("c", 3, "Yes."), ("d", 4, "Yes​."), ("c", 5, "yes."), ("c", 6, None), ("c", 7, " "), ("c", 8, "​"), (None, 9, "Yes."), (None, 10, "Ｙes."),
        ("c", 11, "Yes­."),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv string, id int, text string, f string")
    got = sorted((x.a, x.b) for x in look_alike_pairs(df, "conv", "id", "text").collect())
    assert got == [(1, 2), (1, 11), (2, 3), (2, 11), (3, 11)]
    assert look_alike_pairs(df.where("id < 0"), "conv", "id", "text").count() == 0


def test_hot_group_makes_only_results(spark):
    df = spark.createDataFrame([("c", i, "Yes.") for i in range(5000)] + [("c", 9999, "Yes​.")], "conv string, id int, text string")
    assert look_alike_pairs(df, "conv", "id", "text").count() == 5000
