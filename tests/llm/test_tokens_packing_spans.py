import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm.packing import fill, fill_report, pack
from colloquy.llm.shared_spans import SPAN, Limits, SharedSpans, Texts, kept_boundaries

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


def test_encoding_and_round_trip(spark):
    from colloquy.llm.byte_pairs import Encoder, default_vocabulary, encode_texts

    known = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    known.encode_special_tokens = True
    r = random.Random(1)
    signs = "aaabcdeé ’'\t\n  한국어값123,.-—🙂م ​　"
    texts = [None, "", " ", "Hello world, it's 10:30  now\n\n ok", "a" * 300, "-" * 257 + " x", "<|endoftext|> hi", "\x00\x01 q ", "don't we'll I'M", "word " * 3000] + ["".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, ids string")
    got = encode_texts(df, "text")
    assert got.columns == ["id", "ids"]
    e = Encoder(spark, default_vocabulary())
    for x in got.withColumn("back", e.decode(F.col("ids"))).collect():
        t = texts[x.id] or ""
        assert list(x.ids) == known.encode(t, add_special_tokens=False).ids, t
        assert x.back == t
    plain = df.select("id", e.encode(F.col("text")).alias("ids"))  # without words held ready
    assert {x.id: list(x.ids) for x in plain.collect()} == {x.id: list(x.ids) for x in got.collect()}
    assert encode_texts(df.where("false"), "text").count() == 0


def test_fill():
    r = np.random.default_rng(1)
    n = np.minimum(64, r.geometric(0.06, 800))
    loss = np.minimum(40, (n * r.random(800)).astype(int))
    d = np.column_stack([n, np.ones_like(n), loss])
    c = fill(d, np.array([64, 6, 40]))
    with pytest.raises(ValueError, match="exceeds"):
        fill(d, np.array([3, 6, 40]))
    for k, limit in enumerate((64, 6, 40)):
        assert np.bincount(c, weights=d[:, k]).max() <= limit
    assert c.max() + 1 <= 1.15 * max(n.sum() / 64, 800 / 6, loss.sum() / 40) + 1


def test_pack(spark):
    rows = [(1, 100), (2, 10), (3, 5), (4, 0), (5, None), (6, 1), (6, 1), (None, 4), (7, 205), (8, 99_990), (9, 100)]
    got = pack(spark.createDataFrame([(*x, "z") for x in rows], "id int, n int, shard string"), "id", "n", 100).collect()
    whole = {}
    for x in got:
        whole.setdefault(x.id, []).append((x.start, x.n_tokens))
    assert {i: sum(n for _, n in p) for i, p in whole.items()} == {1: 100, 2: 10, 3: 5, 6: 1, 7: 205, 8: 99_990, 9: 100}
    assert all(len(p) == -(-sum(n for _, n in p) // 100) for p in whole.values())
    used = {}
    for x in got:
        used[x.container] = used.get(x.container, 0) + x.n_tokens
    assert max(used.values()) <= 100
    assert pack(spark.createDataFrame([], "id int, n int"), "id", "n", 100).count() == 0


def test_pack_within_max_loss(spark):
    items = [(1, 100, 90), (2, 100, 40), (3, 80, 41), (4, 250, 250), (5, 250, 10), (6, 30, 0), (7, 99, 3), (8, 1, 1), (9, 1000, 401)]
    got = pack(spark.createDataFrame(items, "id int, n int, l int"), "id", "n", 100, loss="l", max_loss=40).collect()
    pieces, used = {}, {}
    for x in sorted(got, key=lambda x: (x.id, x.piece_no)):
        pieces.setdefault(x.id, []).append((x.start, x.n_tokens, x.n_loss))
        a, b = used.get(x.container, (0, 0))
        used[x.container] = (a + x.n_tokens, b + x.n_loss)
    for i, n, loss in items:
        assert (sum(p[1] for p in pieces[i]), sum(p[2] for p in pieces[i])) == (n, loss)
        assert [p[0] for p in pieces[i]] == [sum(p[1] for p in pieces[i][:k]) for k in range(len(pieces[i]))]
    assert {i: len(pieces[i]) for i in (2, 5, 6, 7, 8)} == {2: 1, 5: 3, 6: 1, 7: 1, 8: 1}
    assert max(a for a, _ in used.values()) <= 100 and max(b for _, b in used.values()) <= 40


def test_shards_are_packed_together(spark):
    r = random.Random(8)
    items = [(i, r.randrange(1, 100), r.randrange(0, 60)) for i in range(3000)]
    df = spark.createDataFrame(items, "id int, n int, l int")
    got = pack(df, "id", "n", 100, 7, "l", 60, shard_items=300)
    assert sorted((x.id, x.n_tokens, x.n_loss) for x in got.collect()) == sorted((i, n, min(n, k)) for i, n, k in items)
    one, many = (fill_report(x, 100, 7, 60).first() for x in (pack(df, "id", "n", 100, 7, "l", 60), got))
    assert many.max_tokens <= 100 and many.max_segments <= 7 and many.max_loss <= 60
    assert one.least_containers <= one.containers <= many.containers <= 1.04 * one.containers
    none = fill_report(pack(df.where("false"), "id", "n", 100), 100, 7, 60).first()
    assert (none.containers, none.n_tokens, none.least_containers) == (0, 0, 0)


def windows(t, span=SPAN):
    return {t[i : i + span] for i in range(len(t) - span + 1)}


def documents(seed):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.choice([1, 3, 5, 9, 22]))) for _ in range(30)]
    gaps = [" ", " ", ", ", ".\n", "—", "", "😀 "]
    text = lambda n: "".join(r.choice(vocab) + r.choice(gaps) for _ in range(n))
    shared = [text(60)[:k] for k in (239, 240, 241, 260, 500)]
    runs = ["-" * 300, "ab" * 150, "=" * 239 + "x", "-" * 240, " " * 400]
    docs = []
    for _ in range(36):
        parts = [text(r.randrange(30)) for _ in range(3)]
        for _ in range(r.randrange(3)):
            parts.insert(r.randrange(4), r.choice(shared + runs[: r.randrange(1, 6)]))
        docs.append("".join(parts))
    docs += [docs[0], docs[1], None, "", "short", "가나다 " * 100, "가나다 " * 90 + "끝", "z" * 100_000]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_spans(spark, seed):
    docs = documents(seed)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)] + [(0, docs[0], 0)], "id int, text string, h int")
    s = SharedSpans(df, "id", "text")
    got = sorted((x.a, x.b) for x in s.pairs().collect())
    w = [windows(t or "") for t in docs]
    want = sorted((a, b) for a in range(len(docs)) for b in range(a + 1, len(docs)) if w[a] & w[b])
    assert got == want
    shared = {x.id: x.shared for x in s.shared_characters().collect()}
    for i, t in enumerate(docs):
        if t and len(t) >= SPAN:
            elsewhere = set().union(*(x for k, x in enumerate(w) if k != i))
            cover = np.zeros(len(t) + 1, int)
            for k in range(len(t) - SPAN + 1):
                if t[k : k + SPAN] in elsewhere:
                    cover[k] += 1
                    cover[k + 1] -= 0
                    cover[min(k + SPAN, len(t))] -= 1
            assert shared[i] == int((np.cumsum(cover) > 0).sum()), i


@pytest.mark.parametrize("span", [24, 50, 101])
def test_other_lengths(spark, span):
    docs = [d if d is None else d[:3000] for d in documents(span)]
    s = SharedSpans(spark.createDataFrame(list(enumerate(docs)), "id int, text string"), "id", "text", span)
    w = [windows(t or "", span) for t in docs]
    assert sorted((x.a, x.b) for x in s.pairs().collect()) == sorted((a, b) for a in range(len(docs)) for b in range(a + 1, len(docs)) if w[a] & w[b])
    shared = {x.id: x.shared for x in s.shared_characters().collect()}
    for i, t in enumerate(docs):
        if t and len(t) >= span:
            elsewhere = set().union(*(x for k, x in enumerate(w) if k != i))
            cover = np.zeros(len(t), bool)
            for k in range(len(t) - span + 1):
                if t[k : k + span] in elsewhere:
                    cover[k : k + span] = True
            assert shared[i] == int(cover.sum()), i
    with pytest.raises(ValueError, match="24"):
        Limits(23)


def test_one_passage_in_very_many_texts(spark):
    r = random.Random(3)
    word = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(n))
    licence = word(80)
    rows = [(i, f"{word(30)} {licence} {word(30)}") for i in range(3000)] + [(5000 + i, licence) for i in range(500)] + [(9000, word(200))]
    s = SharedSpans(spark.createDataFrame(rows, "id int, text string").repartition(4), "id", "text")
    least = len(licence)
    shared = {x.id: x.shared for x in s.shared_characters().collect()}
    assert all(least <= shared[i] <= least + 30 for i, _ in rows[:3000]) and shared[9000] == 0 and shared[5000] == least
    assert s.pairs().count() == 3500 * 3499 // 2


def test_every_stretch_keeps_a_boundary():
    r = random.Random(7)
    for _ in range(40):
        t = "".join(r.choice(["a", "b", "ab", " ", "-", "xyz ", "wordy " * 3, "q" * 30]) for _ in range(400))
        p = np.array([ord(c) for c in t], np.int32)
        _, at, _ = kept_boundaries(Texts(p, np.array([0, len(p)])))
        for i in range(0, len(t) - SPAN + 1):
            assert ((at >= i + Limits().reach) & (at <= i + SPAN - Limits().reach)).any()
        cut = r.randrange(0, len(t) - SPAN)  # the same stretch alone keeps a boundary that the whole text keeps too
        part = p[cut : cut + SPAN]
        _, alone, _ = kept_boundaries(Texts(part, np.array([0, SPAN])))
        assert set(alone + cut) & set(at)


def test_hashes_do_not_depend_on_the_piece():
    a, b = np.arange(50, dtype=np.int32), np.arange(20, 40, dtype=np.int32)
    one, two = Texts(a, np.array([0, 50])), Texts(b, np.array([0, 20]))
    assert one.hashes(np.array([22]), np.array([35])) == two.hashes(np.array([2]), np.array([15]))
