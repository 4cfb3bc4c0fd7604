"""One consistent form for texts that look the same.

The form of a text: width variants, no-break variants and typographic ligatures
become their plain letters; signs that show nothing are absent; every stretch of
spacing is one space, none at either end; letters of another script drawn like a
Latin one become that Latin letter; marks are in canonical order and composed.
Case, accents, punctuation and raised or circled digits stay different.

All of it is gathered from lookup tables over the code points of a whole Arrow
batch: one gather for what a code point expands to, offsets for the expansion,
boolean masks for spacing, and rounds of pairwise composition. No call per row.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.tables import checkpointed

# Letters of other scripts and the Latin letter they are drawn like, by script, after the confusable characters that Unicode publishes.
LOOK_ALIKE = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "γ": "y", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "υ": "u", "ϲ": "c", "ϳ": "j", "ϱ": "p",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "Ӏ": "I", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "ү": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԛ": "q", "ԝ": "w", "һ": "h", "ԁ": "d", "ӏ": "l", "ѵ": "v", "ѡ": "w", "г": "r",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "Տ": "S", "Օ": "O", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "յ": "j",
    "ɑ": "a", "ɡ": "g", "‐": "-", "‑": "-", "…": "...", "‥": "..", "․": ".",
}
# Latin letters whose small capital is drawn like the small letter itself.
SAME_SMALL = "COSVWXZ"
# First and last code points of the ranges that show nothing (default-ignorable or format signs).
SHOWS_NOTHING = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
# Hangul arithmetic of the Unicode standard.
L0, V0, T0, S0, L_N, V_N, T_N = 0x1100, 0x1161, 0x11A7, 0xAC00, 19, 21, 28

SPACE = 0x20
N_POINTS = sys.maxunicode + 1


def _spread(ch: str) -> str:
    """What one code point becomes before composition."""
    if ch in LOOK_ALIKE:
        return LOOK_ALIKE[ch]
    if 0xAB70 <= ord(ch) < 0xABC0 and (latin := LOOK_ALIKE.get(ch.upper())):  # small Cherokee letters are drawn as small capitals
        return latin.lower() if latin in SAME_SMALL else unicodedata.lookup(f"LATIN LETTER SMALL CAPITAL {latin}")
    if ch.isspace() or unicodedata.category(ch) in ("Zs", "Zl", "Zp"):
        return " "
    kind, _, rest = unicodedata.decomposition(ch).partition(" ")
    if kind in ("<wide>", "<narrow>", "<noBreak>") or (kind == "<compat>" and (unicodedata.category(ch) == "Nl" or unicodedata.category(ch) in ("Ll", "Lu", "Lt") and " " in rest)):
        return "".join(_spread(chr(int(x, 16))) for x in rest.split())
    if kind and kind[0] != "<":
        return "".join(_spread(x) for x in unicodedata.normalize("NFD", ch))
    return ch


@cache
def tables() -> dict[str, np.ndarray]:
    """Lookup tables over all code points, made once per process by rule from the Unicode data."""
    offset, length, ccc = np.arange(N_POINTS, dtype=np.int32), np.ones(N_POINTS, np.uint8), np.zeros(N_POINTS, np.uint8)
    out: list[int] = []
    nothing = np.zeros(N_POINTS, bool)
    for a, b in SHOWS_NOTHING:
        nothing[a : b + 1] = True
    pairs: dict[tuple[int, int], int] = {}
    quiet = {"Cn", "Co", "Cs"}
    for p in range(N_POINTS):
        if 0x3400 <= p < 0xA000 or 0xAC00 <= p < 0xD7A4 or 0x17000 <= p < 0x1B000 or 0x20000 <= p < 0xE0000 or p >= 0xE1000:
            continue  # ideographs, syllables and private signs stand for themselves
        ch = chr(p)
        if unicodedata.category(ch) in quiet:
            continue
        nothing[p] |= unicodedata.category(ch) == "Cc" and not ch.isspace()
        ccc[p] = unicodedata.combining(ch)
        whole = unicodedata.decomposition(ch)
        if whole and whole[0] != "<" and " " in whole and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in whole.split())
            pairs[a, b] = p
        s = _spread(ch)
        if s != ch:
            offset[p], length[p] = N_POINTS + len(out), len(s)
            out += map(ord, s)
    for p in range(S0, S0 + L_N * V_N * T_N):  # syllables as they are: composition below rebuilds split ones
        offset[p] = p
    length[nothing] = 0
    stretch = np.concatenate([np.arange(N_POINTS, dtype=np.int32), np.array(out, np.int32)])
    keys = np.array([a << 21 | b for a, b in pairs], np.int64)
    order = np.argsort(keys)
    return {"offset": offset, "length": length, "stretch": stretch, "ccc": ccc, "pair": keys[order], "whole": np.array(list(pairs.values()), np.int32)[order]}


def points_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a string column, one after the other, and how many each row has (null: none)."""
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(column.buffers()[2], np.uint8, offsets[-1] - offsets[0], offsets[0]) if column.buffers()[2] else np.zeros(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int32)
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points, np.diff(before[offsets - offsets[0]])


def strings_of(points: np.ndarray, lengths: np.ndarray, null: np.ndarray) -> pa.Array:
    """The inverse of points_of; rows where null is true become null."""
    raw = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(size)])
    offsets = ends[np.concatenate([[0], np.cumsum(lengths)])].astype(np.int64)
    valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [valid, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)]).cast(pa.string())


def _expand(points: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = t["length"][points].astype(np.int64)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) - np.repeat(ends - n, n) + np.repeat(t["offset"][points].astype(np.int64), n)
    return t["stretch"][at], np.repeat(row, n)


def _reorder(points: np.ndarray, row: np.ndarray, ccc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order of marks: stable by class behind each starter."""
    marks = ccc > 0
    if not (marks[1:] & marks[:-1]).any():
        return points, ccc
    starter = np.cumsum(~marks | np.concatenate([[True], row[1:] != row[:-1]]))
    order = np.lexsort([ccc, starter])
    return points[order], ccc[order]


def _compose(points: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Join letters with their marks, and split Hangul syllables, round by round."""
    points, ccc = _reorder(points, row, t["ccc"][points])
    keep = np.ones(len(points), bool)
    for second_of, made in ((lambda p: (p >= V0) & (p < V0 + V_N), lambda a, b: S0 + ((a - L0) * V_N + (b - V0)) * T_N), (lambda p: (p > T0) & (p < T0 + T_N), lambda a, b: a + b - T0)):
        if not len(points):
            break
        a, b = points[:-1], points[1:]
        fits = second_of(b) & (row[1:] == row[:-1])
        fits &= (a >= L0) & (a < L0 + L_N) if made(L0, V0) == S0 else (a >= S0) & (a < S0 + L_N * V_N * T_N) & ((a - S0) % T_N == 0)
        at = np.flatnonzero(fits)
        if len(at):
            points = points.copy()
            points[at] = made(points[at], points[at + 1])
            keep = np.ones(len(points), bool)
            keep[at + 1] = False
            points, row, ccc = points[keep], row[keep], ccc[keep]
    while True:  # each round tries the first mark that is left behind each letter
        marks = np.flatnonzero(ccc > 0)
        if not len(marks):
            break
        fresh = np.concatenate([[True], row[1:] != row[:-1]])
        starter = np.maximum.accumulate(np.where((ccc == 0) | fresh, np.arange(len(points)), 0))
        base = starter[marks]
        blocked = (base == marks) | ((marks - base > 1) & (ccc[marks - 1] == ccc[marks]))
        key = points[base].astype(np.int64) << 21 | points[marks]
        where = np.minimum(np.searchsorted(t["pair"], key), len(t["pair"]) - 1)
        fits = (t["pair"][where] == key) & ~blocked & (ccc[base] == 0)
        if not fits.any():
            break
        hit, first = np.unique(base[fits], return_index=True)
        used = np.flatnonzero(fits)[first]
        points = points.copy()
        points[hit] = t["whole"][where[used]]
        keep = np.ones(len(points), bool)
        keep[marks[used]] = False
        points, row, ccc = points[keep], row[keep], ccc[keep]
    return points, row


def _squeeze(points: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One space for each stretch of spacing, none at either end of a row."""
    space = points == SPACE
    if not space.any():
        return points, row
    at_edge = np.ones(len(points), bool)
    at_edge[1:] = row[1:] != row[:-1]
    again = np.zeros(len(points), bool)
    again[1:] = space[:-1] & ~at_edge[1:]
    keep = ~(space & (at_edge | again))
    points, row = points[keep], row[keep]
    ends = np.ones(len(points), bool)
    ends[:-1] = row[1:] != row[:-1]
    keep = ~((points == SPACE) & ends)
    return points[keep], row[keep]


def visual_array(column: pa.Array) -> pa.Array:
    """The consistent form of every text of a column; null stays null."""
    t = tables()
    points, lengths = points_of(column)
    null = np.asarray(column.is_null())
    if (points < 0x80).all():
        row = np.repeat(np.arange(len(lengths)), lengths)
        if (points < SPACE).any() or (points == 0x7F).any():
            shown = t["length"][points] > 0
            points, row = t["stretch"][t["offset"][points[shown]]], row[shown]
        points, row = _squeeze(points, row)
    else:
        points, row = _expand(points, np.repeat(np.arange(len(lengths)), lengths), t)
        points, row = _compose(*_squeeze(points, row), t)
    return strings_of(points, np.bincount(row, minlength=len(lengths)), null)


def with_visual_form(df: DataFrame, text: str, out: str = "visual_form") -> DataFrame:
    """Add ``out``, the consistent form of ``text``; every other column and every row stays.

    A null text gives null, an empty or blank one the empty string. A column that
    has the name ``out`` already is replaced. Texts of any length are taken whole.
    """
    rest = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(out, T.StringType())])
    place = rest.index(text) if text in rest else None
    if place is None:
        raise ValueError(f"no column {text}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, visual_array(b.column(place))], schema=None, names=[*rest, out])

    return df.select(*rest).mapInArrow(run, schema)


def _hashed(c: str) -> list[Column]:
    """A text as two independent 64-bit hashes; Spark's own, which see the whole text."""
    return [F.xxhash64(c).alias(f"{c}1"), F.xxhash64(F.lit(11), c, F.length(c)).alias(f"{c}2")]


def look_alike_pairs(df: DataFrame, within: str, record: str, text: str) -> DataFrame:
    """Pairs of records of one group whose texts look the same but differ in their code points.

    Result: ``a`` < ``b`` (record ids). Null and blank texts pair with nothing;
    repeated rows of a record count once. The form of every text is made once and written as a 128-bit hash, as is the text, so
    that nothing below moves a text. Groups without two different texts of one form are
    dropped by a plain aggregation first; pairs are then made between the different
    texts of a form, never within equal ones, so nothing is made that isn't a result.
    """
    rows = df.select(F.col(within).alias("g"), F.col(record).alias("r"), F.col(text).alias("t")).where("g is not null and r is not null and t is not null")
    formed = with_visual_form(rows, "t", "f").where("f <> ''").select("g", "r", *_hashed("f"), *_hashed("t"))
    formed = checkpointed(formed)
    form, t = ["g", "f1", "f2"], F.struct("t1", "t2")
    varied = formed.groupBy(*form).agg(F.min(t).alias("lo"), F.max(t).alias("hi")).where("lo <> hi").select(*form)
    kept = checkpointed(formed.join(varied, form, "left_semi").select(*form, t.alias("t"), "r").distinct())
    texts = kept.select(*form, "t").distinct()
    other = texts.select(*form, F.col("t").alias("u")).join(texts, form).where("t < u")
    left = kept.select(*form, "t", F.col("r").alias("x"))
    right = kept.select(*form, F.col("t").alias("u"), F.col("r").alias("y"))
    pairs = other.join(left, [*form, "t"]).join(right, [*form, "u"]).where("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
