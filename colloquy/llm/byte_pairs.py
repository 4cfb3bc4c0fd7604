"""Byte-pair encoding in Spark's own expressions.

A text is cut into words by the vocabulary's pattern; each word is an array of byte ids,
and a fold merges the adjacent pair of the lowest rank until none is left. The rank map
is a constant of the plan, laid out as a perfect hash table so that a look-up takes the
same few steps whatever the size of the vocabulary (Spark searches a map
literal from end to end). Words that are frequent in a bounded sample are held
ready in a second constant table; every other word is folded where it stands, so the
result is the same whatever the sample was.
"""

from __future__ import annotations

import json
from base64 import b64encode
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The pattern that cuts a text into words, its white space spelt out because Java's \s knows only ASCII.
WHITE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
NONE = 2**31 - 1  # rank of a pair that doesn't merge
P1, P2 = 65_521, 65_497  # primes of the hash below
SAMPLE_DOCUMENTS, READY_WORDS, READY_SLOTS = 2_000, 20_000, 1 << 16


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@dataclass(frozen=True)
class Vocabulary:
    """byte_ids: id of each byte; merges: (left id, right id, id of both) by rank; pieces: bytes of each id."""

    byte_ids: tuple[int, ...]
    merges: np.ndarray
    pieces: tuple[bytes, ...]


def _byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level vocabulary file (JSON with ``model.vocab`` and ``model.merges``)."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    vocab, signs = model["vocab"], _byte_signs()
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64)
    byte_ids = [0] * 256
    for sign, b in signs.items():
        byte_ids[b] = vocab[sign]
    pieces = [b""] * (max(vocab.values()) + 1)
    for word, i in vocab.items():
        pieces[i] = bytes(signs[c] for c in word) if all(c in signs for c in word) else word.encode()
    if not (np.diff(merges[:, 2]) > 0).all():
        raise ValueError("ids of merged pieces must rise with the rank")
    return Vocabulary(tuple(byte_ids), merges, tuple(pieces))


def perfect_hash(keys: np.ndarray, n_buckets: int, n_slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Displacement of each bucket and slot of each key, such that no two keys share a slot."""
    bucket, a, b = keys % n_buckets, keys % P1, 1 + keys % P2
    groups = np.split(np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=n_buckets))[:-1])
    moved, slots, taken = np.zeros(n_buckets, np.int64), np.zeros(len(keys), np.int64), np.zeros(n_slots, bool)
    for g in sorted((g for g in groups if len(g)), key=len, reverse=True):
        for d in range(n_slots):
            at = (a[g] + d * b[g]) % n_slots
            if not taken[at].any() and len(set(at.tolist())) == len(at):
                break
        else:
            raise ValueError("no perfect hash; use more slots")
        moved[bucket[g[0]]], slots[g], taken[at] = d, at, True
    return moved, slots


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _literal_row(one: DataFrame) -> Column:
    """The only row of a bounded DataFrame as a literal struct.

    The row is taken as the engine's compact row; a literal of nested plain values would be
    compared element by element in every round of the optimiser.
    """
    from pyspark.sql.classic.column import Column as ClassicColumn

    jvm = one.sparkSession._jvm
    row = one.repartition(1)._jdf.queryExecution().executedPlan().executeCollect()[0]
    kind = jvm.org.apache.spark.sql.types.DataType.fromJson(one.schema.json())
    literal = jvm.org.apache.spark.sql.catalyst.expressions.Literal(row, kind)
    return ClassicColumn(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(literal))


def _spelt(values: np.ndarray | tuple[int, ...]) -> str:
    return " ".join(map(str, np.asarray(values).tolist()))


class Encoder:
    """Spark expressions that encode and decode by one vocabulary.

    The tables are one literal row in Spark's own compact layout, which the optimiser
    compares and ships as one block of bytes; ``t`` below is that row.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.vocabulary = spark, load_vocabulary(path)
        v = self.vocabulary
        keys = v.merges[:, 0] << 16 | v.merges[:, 1]
        self.n_buckets, self.n_slots = 16_381, 1 + 2 * len(keys) | 1
        moved, slots = perfect_hash(keys, self.n_buckets, self.n_slots)
        packed = np.full(self.n_slots, -1, np.int64)
        packed[slots] = keys << 16 | v.merges[:, 2]
        self.row = (_spelt(moved), _spelt(packed), _spelt(v.byte_ids))

    def tables(self, ready: str = "[]") -> Column:
        """The constant row: moved, packed (the rank map), bytes and ready."""
        one = self.spark.createDataFrame([(*self.row, ready)], "moved string, packed string, bytes string, ready string")
        numbers = lambda c, kind: F.split(c, " ").cast(f"array<{kind}>").alias(c)
        ready_words = F.from_json("ready", "array<struct<w:string,i:array<int>>>").alias("ready")
        return _literal_row(one.select(numbers("moved", "bigint"), numbers("packed", "bigint"), numbers("bytes", "int"), ready_words))

    def rank(self, t: Column, a: Column, b: Column) -> Column:
        """Id of the merged pair (its rank), or NONE."""

        def found(key: Column) -> Column:
            slot = (key % P1 + F.element_at(t["moved"], (key % self.n_buckets + 1).cast("int")) * (1 + key % P2)) % self.n_slots
            entry = F.element_at(t["packed"], (slot + 1).cast("int"))
            return _let(entry, lambda e: F.when(F.shiftright(e, 16) == key, e.bitwiseAND(F.lit(0xFFFF))).otherwise(NONE).cast("int"))

        return _let(a.cast("bigint") * 65536 + b, found)

    def fold(self, t: Column, word: Column) -> Column:
        """Ids of one word, by folding ranked merges over its bytes."""
        letters = F.filter(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: c != "")
        ids = F.transform(letters, lambda c: F.element_at(t["bytes"], F.ascii(c) + 1))
        rank = lambda a, b: self.rank(t, a, b)

        def begin(ids: Column) -> Column:
            pairs = F.zip_with(F.slice(ids, 1, F.size(ids) - 1), F.slice(ids, 2, F.size(ids) - 1), rank)
            return F.struct(ids.alias("ids"), pairs.alias("ranks"))

        def merge(state: Column, least: Column) -> Column:
            ids, ranks = state["ids"], state["ranks"]
            nothing = F.slice(ranks, 1, 0)

            def at(p: Column) -> Column:
                n = F.size(ids)
                left = F.when(p > 1, F.array(rank(F.element_at(ids, F.greatest(p - 1, F.lit(1))), least))).otherwise(nothing)
                right = F.when(p + 1 < n, F.array(rank(least, F.element_at(ids, F.least(p + 2, n))))).otherwise(nothing)
                new_ids = F.concat(F.slice(ids, 1, p - 1), F.array(least), F.slice(ids, p + 2, n))
                new_ranks = F.concat(F.slice(ranks, 1, F.greatest(p - 2, F.lit(0))), left, right, F.slice(ranks, p + 2, n))
                return F.struct(new_ids.alias("ids"), new_ranks.alias("ranks"))

            return _let(F.array_position(ranks, least).cast("int"), at)

        def step(state: Column, _: Column) -> Column:
            return _let(F.array_min(state["ranks"]), lambda least: F.when(least < NONE, merge(state, least)).otherwise(state))

        return _let(ids, lambda i: F.when(F.size(i) < 2, i).otherwise(F.aggregate(F.sequence(F.lit(2), F.size(i)), begin(i), step)["ids"]))

    def ready(self, documents: DataFrame, text: str) -> str:
        """Words that are frequent in ``documents``, each in one of its two slots of a table, with their ids (JSON).

        At most READY_WORDS are held; they save work and change no result.
        """
        words = documents.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(WORDS), F.lit(0))).alias("w"))
        top = words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(READY_WORDS)
        slots: list[dict | None] = [None] * READY_SLOTS
        tables = self.tables()
        for r in top.select("w", _let(tables, lambda t: self.fold(t, F.col("w"))).alias("i")).collect():
            h = xxhash.xxh64_intdigest(r["w"].encode(), seed=42)
            free = [x for x in (h % READY_SLOTS, (h >> 32) % READY_SLOTS) if slots[x] is None]
            if free:
                slots[free[0]] = {"w": r["w"], "i": list(r["i"])}
        return json.dumps(slots, ensure_ascii=False)

    def encode(self, text: Column, ready: str | None = None) -> Column:
        """Ids of a text; null and empty give an empty array. Nothing in a text is special."""
        words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))

        def held(t: Column, word: Column, shift: int) -> Column:
            h = F.shiftrightunsigned(F.xxhash64(word), shift) if shift else F.xxhash64(word)
            return F.element_at(t["ready"], (h.bitwiseAND(F.lit(READY_SLOTS - 1)) + 1).cast("int"))

        def looked_up(t: Column, words: Column) -> Column:
            second = lambda w: _let(held(t, w, 32), lambda r: F.when(r["w"] == w, r["i"]).otherwise(self.fold(t, w)))
            return F.zip_with(words, F.transform(words, lambda w: held(t, w, 0)), lambda w, r: F.when(r["w"] == w, r["i"]).otherwise(second(w)))

        def ids(t: Column) -> Column:
            return F.transform(words, lambda w: self.fold(t, w)) if ready is None else _let(words, lambda w: looked_up(t, w))

        found = F.flatten(_let(self.tables(ready or "[]"), ids))
        return F.coalesce(found, F.array().cast("array<int>"))

    def decode(self, ids: Column) -> Column:
        """The text of an array of ids: the pieces' bytes one after the other."""
        one = self.spark.createDataFrame([(json.dumps([b64encode(p).decode() for p in self.vocabulary.pieces]),)], "p string")
        pieces = _literal_row(one.select(F.from_json("p", "array<binary>").alias("p")))
        return F.decode(_let(pieces, lambda t: F.aggregate(ids, F.lit(b""), lambda all_, i: F.concat(all_, F.element_at(t["p"], i + 1)))), "UTF-8")


def encode_texts(df: DataFrame, text: str, out: str = "ids", path: str | None = None) -> DataFrame:
    """Replace ``text`` by ``out``, its token ids (array of int).

    Null and empty texts give an empty array; texts are taken whole; all other columns
    stay (one that is named ``out`` already is replaced). ``path``: the vocabulary file.
    """
    encoder = Encoder(df.sparkSession, path or default_vocabulary())
    ready = encoder.ready(df.select(text).where(F.col(text).isNotNull()).limit(SAMPLE_DOCUMENTS), text)
    rest = [c for c in df.columns if c not in (text, out)]
    return df.select(*rest, encoder.encode(F.col(text), ready).alias(out))
