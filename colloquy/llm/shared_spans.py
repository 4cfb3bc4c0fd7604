"""Long exact spans that documents share, by recompression.

A text is parsed in rounds, as in recompression: first words become symbols, then
short runs of one symbol and pairs of neighbours are named anew, a pair when the first
symbol's name falls into one half of the alphabet and the second's into the other. A name
is a hash of what it stands for, so all tasks give the same name to the same
thing without asking each other, and equal substrings get the same interior symbols
wherever they stand. What a symbol may join is limited by its length, which limits how
far the edges of a substring can disturb its parse (the reach).

Then rounds over the whole corpus name longer and longer symbols and keep those that stand in
more than one text, each round by one aggregation and a join of the names it keeps:

1. A boundary between symbols is named by the text within one reach of it. Of these
   names those are kept that are smallest within some stretch of span - 2 * reach + 1 characters; a
   shared span of span characters then always holds a kept boundary, with the same name in both texts.
2. A shared name paired with as much of the text before it, or behind it, as half of what the span has beside the name.
3. Around the boundaries that have such a pair in common, the stretches of span - STRIDE characters at every STRIDE.
4. Within the shared ones of those, the stretches of span characters.

What round 4 keeps is what is shared. No round makes pairs: a symbol's texts are counted by their least and
greatest. Pairs are only made when they are asked for, once for each set of texts, and every one that comes
out has been compared as text.

Proof of the reach: a token cut by the edge of the span costs at most ``token`` characters (a longer
one is single characters in any case), a run at the edge at most its limit (a
longer run isn't joined in any case), a pair across the edge at most its limit.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.visual_form import N_POINTS, points_of
from colloquy.operators.coverage import periods_and_gaps
from colloquy.tables import checkpointed

SPAN, LEAST_SPAN = 240, 24
STRIDE = 8
SALTS = 16  # parts over which the texts of one name are spread
BLOCK = 1_000  # members of one set that meet in a task
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
PIECE = 1 << 21  # bytes of text that are worked on at a time


@dataclass(frozen=True)
class Limits:
    """What follows from the length of a span: token, the longest word that is one symbol, and of each round the longest run and the longest symbol that are joined; a sixth of the span in all."""

    span: int = SPAN

    def __post_init__(self) -> None:
        if self.span < LEAST_SPAN:
            raise ValueError(f"a span has {LEAST_SPAN} characters at least")

    @property
    def token(self) -> int:
        return self.span * 10 // 240

    @property
    def rounds(self) -> tuple[tuple[int, int], ...]:
        return tuple((self.span * a // 240, self.span * b // 240) for a, b in ((2, 4), (4, 8), (0, 12)))

    @property
    def reach(self) -> int:
        return self.token + sum(a + b for a, b in self.rounds)

    @property
    def extra(self) -> int:
        """Characters that are looked at on either side of a name's text."""
        return self.span - 2 * self.reach


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection that scatters 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


@cache
def word_signs() -> np.ndarray:
    """Whether a code point is a letter, mark or digit."""
    return np.array([unicodedata.category(chr(p))[0] in "LMN" for p in range(N_POINTS)], bool)


@dataclass
class Texts:
    """Several texts as one array of code points; row i is points[starts[i]:starts[i + 1]]."""

    points: np.ndarray
    starts: np.ndarray

    def __post_init__(self) -> None:
        n = len(self.points)
        rising, falling = (np.full(n + 1, b, np.uint64) for b in (BASE, INVERSE))
        rising[0] = falling[0] = 1
        self.falling = np.cumprod(falling)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(self.points.astype(np.uint64) + np.uint64(1)) * np.cumprod(rising)[:-1], out=self.sums[1:])
        self.n = n

    def hashes(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of points[lo:hi]; depends on nothing but their values, wherever they stand and whatever stands beside them."""
        return mix((self.sums[hi] - self.sums[lo]) * self.falling[lo] + (hi - lo).astype(np.uint64) * M2)


def _boundaries(t: Texts, limits: Limits) -> np.ndarray:
    """Starts of the top symbols."""
    row_start = np.zeros(t.n + 1, bool)
    row_start[t.starts[:-1]] = True
    row_start = row_start[: t.n]
    word = word_signs()[t.points]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    begin |= row_start
    at = np.flatnonzero(begin)
    length = np.diff(np.append(at, t.n))
    long = np.repeat(length > limits.token, length)
    at = np.flatnonzero(begin | long)
    length = np.diff(np.append(at, t.n))
    name = t.hashes(at, at + length)
    fresh = row_start[at]  # a symbol that begins a text joins nothing before it
    for k, (run_limit, pair_limit) in enumerate(limits.rounds):
        if run_limit:
            first = np.ones(len(at), bool)
            first[1:] = (name[1:] != name[:-1]) | fresh[1:]
            heads = np.flatnonzero(first)
            copies = np.diff(np.append(heads, len(at)))
            short = (copies > 1) & (copies * length[heads] <= run_limit)
            if short.any():
                keep = first | ~np.repeat(short, copies)
                of = np.zeros(len(at), np.int64)
                of[heads] = np.where(short, copies, 1)
                times = of[keep]
                times[times == 0] = 1
                at, name, fresh, length = at[keep], name[keep], fresh[keep], length[keep] * times
                joined = times > 1
                name[joined] = mix(name[joined] + times[joined].astype(np.uint64) * M1)
        half = (mix(name + np.uint64(k + 1)) >> np.uint64(63)).astype(bool)
        small = length <= pair_limit
        pair = ~half[:-1] & half[1:] & small[:-1] & small[1:] & ~fresh[1:]
        heads = np.flatnonzero(pair)
        name[heads] = mix(name[heads] * M1 + mix(name[heads + 1]))
        length[heads] += length[heads + 1]
        keep = np.ones(len(at), bool)
        keep[heads + 1] = False
        at, name, fresh, length = at[keep], name[keep], fresh[keep], length[keep]
    return at


def kept_boundaries(t: Texts, limits: Limits = Limits()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and name of the boundaries that are smallest within some stretch."""
    reach, span = limits.reach, limits.span
    at = _boundaries(t, limits)
    row = np.searchsorted(t.starts, at, "right") - 1
    lo, hi = t.starts[row] + reach, t.starts[row + 1] - reach
    ok = (at >= lo) & (at <= hi) & (t.starts[row + 1] - t.starts[row] >= span)
    at, row, lo, hi = at[ok], row[ok], lo[ok], hi[ok]
    name = t.hashes(at - reach, at + reach)
    width = span - 2 * reach + 1
    n = len(at)
    ends = []
    for sign, edge in ((-1, lo - 1), (1, hi + 1)):  # the nearest boundary of a smaller name on either side, as far as it matters
        found = edge.copy()
        active = np.arange(n)
        step = 1
        while len(active):
            other = active + sign * step
            inside = (other >= 0) & (other < n)
            active, other = active[inside], other[inside]
            near = (row[other] == row[active]) & (abs(at[other] - at[active]) <= width)
            active, other = active[near], other[near]
            smaller = (name[other] < name[active]) | ((name[other] == name[active]) & (sign < 0))
            found[active[smaller]] = at[other[smaller]]
            active = active[~smaller]
            step += 1
        ends.append(found)
    keep = ends[1] - ends[0] > width
    return row[keep], at[keep], name[keep]


def _pieces(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Rows in pieces of about PIECE bytes of text, so that a batch of long texts takes no more memory than one of short ones; a longer text is a piece of its own."""
    for whole in batches:
        ends = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(whole.column(text)), 0), np.int64))])
        first = 0
        while first < whole.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + PIECE, "right")) - 1)
            b = whole.slice(first, last - first)
            points, lengths = points_of(b.column(text))
            yield b, Texts(points, np.concatenate([[0], np.cumsum(lengths)]))
            first = last


def _names(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    """(c1, c2, text) of different texts -> (c1, c2, at, h, sure).

    A name of several texts of one piece is shared for sure, all of its rows say so, and one more that doesn't stands for it before the other
    pieces; so of a name that stands everywhere a piece sends one row to be counted.
    """
    for b, t in _pieces(batches, 2):
        row, at, name = kept_boundaries(t, limits)
        order = np.lexsort([row, name])
        first = np.ones(len(name), bool)
        first[1:] = name[order][1:] != name[order][:-1]
        group = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        lengths = np.diff(np.append(starts, len(name)))
        several = row[order][starts] != row[order][starts + lengths - 1] if len(starts) else np.zeros(0, bool)
        sure = np.zeros(len(name), bool)
        sure[order] = several[group] if len(starts) else False
        extra = order[starts[several]]
        take, flags = np.concatenate([np.arange(len(name)), extra]), np.concatenate([sure, np.zeros(len(extra), bool)])
        rows = pa.array(row[take])
        place = (at - t.starts[row]).astype(np.int32)[take]
        yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(place), pa.array(name.view(np.int64)[take]), pa.array(flags)], ["c1", "c2", "at", "h", "sure"])


CONTEXT = pa.schema([("h", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("at", pa.int32()), ("ctx", pa.string()), ("n_left", pa.int32())])


def _contexts(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    """(c1, c2, text, marks of (h, at)) -> h, c1, c2, at, the text around it (ctx) and the characters of that before the name's own (n_left)."""
    far = limits.reach + limits.extra
    for b in batches:
        for i in range(b.num_rows):  # texts of any length, one at a time
            text, marks = b.column(2)[i].as_py(), b.column(3)[i].values
            at = np.asarray(marks.field(1)).astype(np.int64)
            first = np.maximum(at - far, 0)
            around = [text[x:y] for x, y in zip(first.tolist(), (at + far).tolist(), strict=True)]
            same = [pa.array(np.full(len(at), b.column(k)[i].as_py(), np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([marks.field(0), *same, pa.array(at.astype(np.int32)), pa.array(around, pa.string()), pa.array((at - limits.reach - first).astype(np.int32))], schema=CONTEXT)


class SharedSpans:
    """What the documents of a table share.

    ``df``: an id (bigint) and a text for each document, further columns are ignored; ``span``: the least length. Null,
    empty and short texts share nothing; repeated rows of an id count once. Equal texts
    are one class, brought together before they are parsed, and are looked at once.
    """

    def __init__(self, df: DataFrame, key: str, text: str, span: int = SPAN):
        self.limits = limits = Limits(span)
        rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where(f"id is not null and length(text) >= {span}")
        keyed = rows.select("id", F.xxhash64("text").alias("c1"), F.xxhash64(F.lit(7), "text", F.length("text")).alias("c2"), "text")
        self.members = keyed.select("id", "c1", "c2", F.length("text").alias("n")).distinct()
        texts = keyed.groupBy("c1", "c2").agg(F.first("text").alias("text"))  # copies are dropped before the exchange, as far as they meet in a task
        names = texts.mapInArrow(lambda it: _names(it, limits), "c1 bigint, c2 bigint, at int, h bigint, sure boolean")
        marks = _of_several_texts(names).groupBy("c1", "c2").agg(F.collect_set(F.struct("h", "at")).alias("marks"))  # of one text
        around = texts.join(marks, ["c1", "c2"]).select("c1", "c2", "text", "marks").mapInArrow(lambda it: _contexts(it, limits), "h bigint, c1 bigint, c2 bigint, at int, ctx string, n_left int")
        self.contexts = checkpointed(around.withColumn("l", F.xxhash64("ctx", "n_left")))
        self._runs()

    def _runs(self) -> None:
        """Kinds of context (h, l) and the texts they stand in; ``windows``: the stretches of span characters (h, w1, w2) that several kinds have, and where."""
        span, extra = self.limits.span, self.limits.extra
        kind, who = ["h", "l"], F.struct("c1", "c2")
        words = [h for seed in (1, 2) for h in (F.shiftright(F.xxhash64(F.lit(seed), "c1", "c2"), 32), F.xxhash64(F.lit(seed), "c1", "c2").bitwiseAND(F.lit(2**32 - 1)))]
        one = F.when(F.min("ctx") == F.max("ctx"), F.min("ctx")).otherwise(F.raise_error(F.lit("two texts of one name")).cast("string"))
        signature = [F.count("*").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(words))]
        self.kinds = kinds = checkpointed(self.contexts.groupBy(*kind).agg(one.alias("ctx"), F.first("n_left").alias("n_left"), F.min(who).alias("lo"), F.max(who).alias("hi"), *signature))
        # how far a stretch of span characters may begin before the name's own text
        ahead, behind = F.least("n_left", F.lit(extra)), F.greatest(F.lit(extra) - (F.length("ctx") - F.col("n_left") - 2 * self.limits.reach), F.lit(0))
        # a shared stretch of span characters holds the half before the name's own text or the half behind it
        half, n_left = extra // 2, F.col("n_left")
        before = F.when(n_left >= half, F.struct(F.lit(0).alias("side"), F.xxhash64(F.substring("ctx", n_left - half + 1, F.lit(half))).alias("w")))
        after = F.when(F.length("ctx") - n_left - 2 * self.limits.reach >= half, F.struct(F.lit(1).alias("side"), F.xxhash64(F.substring("ctx", n_left + 2 * self.limits.reach + 1, F.lit(half))).alias("w")))
        halves = kinds.where(behind <= ahead).select(*kind, F.explode(F.array_compact(F.array(before, after))).alias("x")).select(*kind, "x.*")
        some = kinds.select(*kind, "ctx", "n_left").join(_shared(halves, ["h", "side", "w"], F.col("l"), "l").select(*kind).distinct(), kind, "left_semi")
        k, last = F.col("k"), F.lit(-(-extra // STRIDE) - 1)
        long = some.select(*kind, "ctx", "n_left", F.explode(F.sequence(F.least(F.floor(behind / STRIDE), last), F.least(F.floor(ahead / STRIDE), last))).alias("k"))
        stretch_at = lambda a, n: F.substring("ctx", (F.col("n_left") - a + 1).cast("int"), F.lit(n))
        here, there = k * STRIDE, F.least((k + 1) * STRIDE, F.lit(extra))
        # every stretch that begins k to k + 1 STRIDEs ahead holds this one of span - STRIDE characters; ends: the first and last of those stretches, if there are both
        ends = F.when((here >= behind) & (there <= ahead), F.xxhash64(stretch_at(here, span), stretch_at(there, span))).otherwise(F.col("l"))
        long = long.select(*kind, "k", F.xxhash64(stretch_at(here, span - STRIDE)).alias("w"), ends.alias("ends"))
        near = _fenced(_shared(long, ["h", "k", "w"], F.col("l"), "ends").select(*kind, "k", "same", "group"))
        # kinds that have both ends in common have all stretches between them in common, and nobody else has one of them; of STRIDEs next to each other with the same kinds the outer ends are enough
        even = near.where("same").groupBy(*kind, "group").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
        even = even.select(*kind, F.explode(F.array(F.col("lo") * STRIDE, F.least((F.col("hi") + 1) * STRIDE, F.lit(extra)))).alias("a")).select(*kind, "a", "a")
        fine = near.where("not same").select(*kind, here, F.when(k == last, F.lit(extra)).otherwise(there - 1))
        asked = even.toDF(*kind, "lo", "hi").union(fine.toDF(*kind, "lo", "hi")).join(some, kind)
        every = asked.select(*kind, "ctx", "n_left", F.explode(F.sequence(F.greatest(behind, F.col("lo")).cast("int"), F.least(ahead, F.col("hi")).cast("int"))).alias("a"))
        stretch = stretch_at(F.col("a"), span)
        named = every.select(*kind, "a", F.xxhash64(stretch).alias("w1"), F.xxhash64(F.lit(13), stretch).alias("w2"))
        self.windows = checkpointed(_shared(named, ["h", "w1", "w2"], F.col("l"), "a").select(*kind, "a", "w1", "w2"))

    def shared_characters(self) -> DataFrame:
        """(id, n, shared): characters of each document of at least the span, and how many stand in a span that another document has too."""
        span, reach = self.limits.span, self.limits.reach
        kind = ["h", "l"]
        texts = self.kinds.select(*kind, "lo", "hi")
        apart = self.windows.join(texts, kind).groupBy("h", "w1", "w2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("h", "w1", "w2")  # a text doesn't share with itself
        far = self.windows.join(apart, ["h", "w1", "w2"], "left_semi").groupBy(*kind).agg(F.max("a").alias("before"), F.min("a").alias("after"))
        n_right = F.length("ctx") - F.col("n_left") - 2 * reach
        whole = self.kinds.where((F.col("lo") != F.col("hi")) & (F.length("ctx") >= span)).select(*kind, F.col("n_left").alias("before"), (span - 2 * reach - n_right).alias("after"))
        extent = whole.union(far).groupBy(*kind).agg(F.max("before").alias("before"), F.min("after").alias("after"))
        begin = F.col("at") - reach
        spans = self.contexts.select(*kind, "c1", "c2", "at").join(extent, kind).select("c1", "c2", (begin - F.col("before")).alias("s"), (begin + span - F.col("after")).alias("e"))
        found = periods_and_gaps(spans, ["c1", "c2"], "s", "e").where("kind = 'period'").groupBy("c1", "c2").agg(F.sum(F.col("e") - F.col("s")).alias("shared"))
        copies = self.members.groupBy("c1", "c2").agg(F.count("*").alias("copies"))
        every = self.members.join(found, ["c1", "c2"], "left").join(copies, ["c1", "c2"])
        return every.select("id", "n", F.when(F.col("copies") > 1, F.col("n").cast("bigint")).otherwise(F.coalesce("shared", F.lit(0))).alias("shared"))

    def sets(self) -> DataFrame:
        """(h, w1, w2, c1, c2): one shared stretch for each set of different texts that share one, and those texts; each compared as text.

        Neighbouring stretches of one copied passage have the same texts behind them; one of them stands for all.
        """
        kind, run, sums = ["h", "l"], ["h", "w1", "w2"], ["n", "s0", "s1", "s2", "s3"]
        span = self.limits.span
        crowd = self.kinds.where((F.col("lo") != F.col("hi")) & (F.length("ctx") >= span)).select(*kind, F.col("l").alias("w1"), F.lit(0).cast("bigint").alias("w2"), *sums)
        several = self.windows.join(self.kinds.select(*kind, *sums), kind).groupBy(*run).agg(*(F.sum(x).alias(x) for x in sums))
        chosen = crowd.select(*run, *sums).union(several).groupBy(*sums).agg(F.min(F.struct(*run)).alias("g")).select("g.*")
        of_windows = self.windows.join(chosen, run, "left_semi").join(self.kinds.select(*kind, "ctx", "n_left"), kind)
        of_windows = checkpointed(of_windows.select(*run, "l", F.substring("ctx", F.col("n_left") - F.col("a") + 1, F.lit(span)).alias("t")))
        unlike = of_windows.groupBy(*run).agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi")
        if unlike.limit(1).count():
            raise ArithmeticError("two stretches of one name")
        of_crowds = crowd.join(chosen, run, "left_semi").select(*run, "l")
        held = of_windows.select(*run, "l").union(of_crowds)
        return held.join(self.contexts.select(*kind, "c1", "c2"), kind).select(*run, "c1", "c2").distinct()

    def pairs(self) -> DataFrame:
        """(a, b), a < b: documents with at least one run of span characters in common."""
        c = F.struct("c1", "c2")
        classes = _pairs_within(checkpointed(self.sets()).select(F.struct("h", "w1", "w2").alias("g"), c.alias("x"))).distinct()
        m = self.members.select("id", c.alias("c"))
        blocks = m.groupBy("c").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        placed = m.join(blocks, "c").select("c", "id", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("k"))
        for side, out in (("a", "x"), ("b", "y")):  # the copies of one text in blocks, so that no text is one task
            many = classes.join(blocks.select(F.col("c").alias(side), "blocks"), side).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
            classes = many.join(placed.select(F.col("c").alias(side), "k", F.col("id").alias(out)), [side, "k"]).drop("k")
        within = _pairs_within(m.select(F.col("c").alias("g"), F.col("id").alias("x")))
        return classes.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).union(within)


def _fenced(df: DataFrame) -> DataFrame:
    """The same rows, behind a fence: no filter, join or choice of columns moves below it, so that what lies below is one exchange for all its uses."""
    return df.withColumn("__row", F.monotonically_increasing_id() + F.pmod(F.hash(*df.columns), F.lit(1))).where("__row >= 0").drop("__row")


def _of_several_texts(names: DataFrame) -> DataFrame:
    """Names (c1, c2, at, h, sure) that stand in more than one text: c1, c2, at, h.

    All rows are exchanged once, by name; those that are sure by name and text, as their name may stand anywhere.
    """
    part = F.when(F.col("sure"), 1 + F.pmod(F.xxhash64("c1", "c2"), F.lit(SALTS))).otherwise(0).cast("int")
    placed = _fenced(names.withColumn("part", part).repartition("h", "part"))
    who = F.xxhash64("c1", "c2")
    counted = placed.where("not sure").groupBy("h", "part").agg(F.min(who).alias("lo"), F.max(who).alias("hi")).where("lo <> hi")
    found = placed.join(counted.select("h", "part", F.lit(True).alias("found")), ["h", "part"], "left").where("sure or found")
    return found.select("c1", "c2", "at", "h")


def _shared(rows: DataFrame, name: list[str], who: Column, like: str) -> DataFrame:
    """The rows whose ``name`` stands in more than one ``who`` (a 64-bit hash), with ``same``, whether all of the name agree in ``like``, and ``group``, a hash of all who.

    Rows are exchanged once, by name and part of who, of which there are SALTS, so that a name that stands everywhere is many tasks; its least
    and greatest who are found within the parts, then over them, and the names that are kept go back to just the parts that they have.
    """
    placed = _fenced(rows.withColumn("__part", F.pmod(who, F.lit(SALTS)).cast("int")).repartition(*name, "__part"))
    total = F.sum(F.shiftright(F.xxhash64(who), 32))
    parts = placed.groupBy(*name, "__part").agg(F.min(who).alias("lo"), F.max(who).alias("hi"), F.min(like).alias("lo2"), F.max(like).alias("hi2"), F.count("*").alias("n"), total.alias("s"))
    mask = F.bit_or(F.expr("shiftleft(1, __part)"))
    group = F.xxhash64(F.min("lo"), F.max("hi"), F.sum("n"), F.sum("s"))
    several = parts.groupBy(*name).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.min("lo2") == F.max("hi2")).alias("same"), group.alias("group"), mask.alias("mask")).where("lo <> hi")
    its = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda p: F.getbit(F.col("mask"), p) == 1)
    return placed.join(several.select(*name, "same", "group", F.explode(its).alias("__part")), [*name, "__part"]).select(*rows.columns, "same", "group")


def _pairs_within(rows: DataFrame) -> DataFrame:
    """(a, b), a < b, for all x of one g. A large group is dealt to blocks of BLOCK, and each two of them meet by themselves, so that a task makes no more than BLOCK squared."""
    blocks = rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = rows.join(blocks, "g").withColumn("k", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = placed.select("g", F.col("x").alias("a"), "k", F.explode(every).alias("k2"))
    right = placed.select("g", F.col("x").alias("b"), F.explode(every).alias("k"), F.col("k").alias("k2"))
    return left.join(right, ["g", "k", "k2"]).where("a < b").select("a", "b")
