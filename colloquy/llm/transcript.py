"""Speaker turns from raw transcript lines.

Files of captions or transcripts become lines by one finite-state pass (``caption_lines``). A
line goes through a finite-state parser: in front of the spoken text it takes cue numbers and times,
time stamps, speaker marks, tiers, labels and annotations in any order, then the rest is the
body, which loses its annotations and standalone fillers. Lines are then put in
order over the whole table (range partitions of conversation, time and id, so that
a long conversation is spread over many tasks), a nameless line gets the speaker of the
line before it, and consecutive lines of one speaker become a turn. Only the turns at the
two edges of a partition need their neighbours; they are joined in a small table.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from colloquy.functions.arrow import codes, concat_batches, run_starts
from colloquy.functions.text import clock_ms
from colloquy.llm.identity import participant_id
from colloquy.tables import checkpointed

# Labels whose lines are no speech, and all labels, folded to their letters.
LEFT_OUT = {"nonspeechnoise", "channelbleed"}
# How the two speakers are counted or lettered.
NUMBERS = {"1": 0, "a": 0, "one": 0, "2": 1, "b": 1, "two": 1}

OPEN, CLOSE = r"[\[({<【《]", r"[\])}>】》]"
NAME = r"(?:(?:[^\W\d_]+[\W_]*?)?0*(?P<digit>[12])|(?:[^\W\d_]+[\W_]+)?(?P<word>a|b|one|two))"
MARK = r"(?:(?:speaker|spk|spkr|sp|s|channel|ch|화자)[\s_.#-]*0*(?P<digit>[12])|(?:speaker|spk|spkr|sp|channel|ch|화자)[\s_.#-]+(?P<word>a|b|one|two))"
PERSON = r"p[\s_-]*(?P<person>\d+)"
SPEAKER_FIELD = re.compile(rf"[\W_]*{NAME}[\W_]*")
PERSON_FIELD = re.compile(rf"[\W_]*{PERSON}[\W_]*")
CLOCK = r"(?:\d+:)?\d+:\d\d[.,]\d+"
CUE_TIMES = re.compile(rf"{CLOCK}\s*-->\s*{CLOCK}(?:[ \t]+(?:align|line|position|region|size|vertical):\S+)*")  # of subtitles, with their settings
CUE_NUMBER = re.compile(rf"\d+[ \t]*\n\s*(?={CLOCK}\s*-->)")
STAMP = re.compile(rf"(?:\d+:\d\d:\d\d(?:[.,]\d+)?|{OPEN}\s*(?:t\s*=\s*)?\d[\d:.,]*\s*s?\s*{CLOSE})\s*(?:-->(?:\s*\d+:\d\d:\d\d(?:[.,]\d+)?)?)?")
VOICE = r"(?:v(?:\.[\w.]+)?\s+)?"  # in front of the name in a voice tag
BOXED_SPEAKER = re.compile(rf"{OPEN}\s*{VOICE}(?:{MARK}|(?P<bare>[12]|a|b))\s*{CLOSE}\s*[:>]?")
PLAIN_SPEAKER = re.compile(rf"(?:{MARK}\s*(?:[:>]|-(?=\s))|(?P<bare>[12]|a|b)(?:\s*:(?!\d)|>(?!\d)))")
BOXED_PERSON = re.compile(rf"{OPEN}\s*{VOICE}{PERSON}\s*{CLOSE}\s*[:>]?")
PLAIN_PERSON = re.compile(rf"{PERSON}\s*(?:[:>]|-(?=\s))")
TIER = re.compile(r"\*[a-z][a-z0-9]{1,6}:\s*")  # main tier: a code of three letters, as a rule; of others only two ending in 1 or 2 name somebody
BESIDE = re.compile(r"[%@][a-z]{2,}[^\n]*")  # dependent tiers and headers hold no speech
BOXED = re.compile(r"\[[^\[\]]*\]|\([^()]*\)|\{[^{}]*\}|<[^<>]*>|【[^【】]*】|《[^《》]*》|\*[^*\s][^*]*\*|\x15[^\x15]*\x15")
WORD = re.compile(r"[^\W_]+(?:['’ʼ][^\W_]+)*")
INVISIBLE = re.compile(r"[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
NOT_LETTERS = re.compile(r"[\W\d_]+")
CACHED = 200_000  # words whose count a parser remembers before it begins anew; this saves work and changes no result


def fillers(forms: Iterable[str]) -> re.Pattern:
    """Matches a form, drawn out (each run of one letter at least as long) or doubled."""
    one = []
    for form in sorted({unicodedata.normalize("NFKC", f).casefold() for f in forms if f}):
        runs = re.findall(r"((.)\2*)", form, re.S)
        one.append("".join(f"{re.escape(c)}{{{len(run)},}}" for run, c in runs))
    return re.compile("|".join(f"(?:{x}){{1,2}}" for x in one) or r"(?!)")


def _named(m: re.Match) -> int:
    g = m.groupdict()
    return NUMBERS[g.get("digit") or g.get("word") or g["bare"]]


def plain(values: list[str | None]) -> list[str]:
    """Compatibility form, lower case, without invisible signs and outer spacing; null gives the empty string. One pass over all values together."""
    joined = "\0".join((v or "").replace("\0", " ") for v in values)
    return [v.strip() for v in INVISIBLE.sub("", unicodedata.normalize("NFKC", joined)).casefold().split("\0")]


class LineParser:
    """Finite-state parser of lines in the known layouts.

    Subtitles with or without hours (a cue's number and times in front, voice tags inside), tiers of ``*ABC:`` with ``%abc:`` and ``@``
    lines beside them, and ``NAME: text``. FRONT takes stamps, speaker marks, labels and annotations in any order and leads
    back to itself; anything else leads to BODY.
    """

    FRONT = (
        ("cue", CUE_NUMBER), ("cue", CUE_TIMES), ("stamp", STAMP), ("speaker", BOXED_SPEAKER), ("speaker", PLAIN_SPEAKER), ("person", BOXED_PERSON), ("person", PLAIN_PERSON), ("tier", TIER), ("beside", BESIDE), ("box", BOXED),
    )

    def __init__(self, filler: re.Pattern):
        self.filler, self.counts = filler, {}

    def field(self, speaker: str) -> tuple[int | None, str | None]:
        """Who a speaker field names: a number or a participant."""
        if m := PERSON_FIELD.fullmatch(speaker):
            return None, m["person"]
        return (_named(m), None) if (m := SPEAKER_FIELD.fullmatch(speaker)) else (None, None)

    def text(self, body: str) -> tuple[int | None, str | None, bool, int]:
        """Who is named in front, whether a label there leaves the line out, and the words spoken."""
        number = person = None
        noise, at = False, 0
        while at < len(body):
            if body[at].isspace():
                at += 1
                continue
            for state, pattern in self.FRONT:
                if m := pattern.match(body, at):
                    break
            else:
                break
            at = m.end()
            if number is None and person is None:
                if state == "speaker":
                    number = _named(m)
                elif state == "person":
                    person = m["person"]
                elif state == "tier" and m[0].rstrip()[-2] in "12":
                    number = int(m[0].rstrip()[-2]) - 1
            if state == "box":
                noise = noise or NOT_LETTERS.sub("", m[0]) in LEFT_OUT
        rest, before = body[at:], None
        while rest != before:  # nested annotations go from the inside out
            before, rest = rest, BOXED.sub(" ", rest)
        return number, person, noise, sum(map(self.words, rest.split()))

    def words(self, token: str) -> int:
        """Words in a stretch without spacing; none if all of them are fillers."""
        n = self.counts.get(token)
        if n is None:
            parts = WORD.findall(token)
            n = 0 if all(self.filler.fullmatch(p) for p in parts) else len(parts)
            if len(self.counts) >= CACHED:
                self.counts.clear()
            self.counts[token] = n
        return n

    def lines(self, speakers: list[str | None], labels: list[str | None], texts: list[str | None]) -> Iterator[tuple[int | None, str | None, bool, int]]:
        """Of each line: speaker 0 or 1 if named, participant id if one is named, whether a label leaves it out, words spoken. Equal fields and texts are parsed once."""
        who, noises, bodies = {}, {}, {}
        for s, v in zip(d := list(dict.fromkeys(speakers)), plain(d), strict=True):
            who[s] = self.field(v)
        for s, v in zip(d := list(dict.fromkeys(labels)), plain(d), strict=True):
            noises[s] = NOT_LETTERS.sub("", v) in LEFT_OUT
        for s, v in zip(d := list(dict.fromkeys(texts)), plain(d), strict=True):
            bodies[s] = self.text(v)
        for s, label, t in zip(speakers, labels, texts, strict=True):
            (number, person), (number2, person2, noise, words) = who[s], bodies[t]
            if number is None and person is None:
                number, person = number2, person2
            yield number, ("P" + person.lstrip("0").rjust(7, "0") if person else None), noise or noises[label], words


def parse_line(speaker: str | None, label: str | None, text: str | None, filler: re.Pattern) -> tuple[int | None, str | None, bool, int]:
    """One line by a parser of its own."""
    return next(LineParser(filler).lines([speaker], [label], [text]))


FINAL, EDGE, MARK_ROW = 0, 1, 2
PART = T.StructType(
    [
        T.StructField("kind", T.IntegerType()), T.StructField("pid", T.IntegerType()), T.StructField("pos", T.LongType()), T.StructField("conv", T.StringType()), T.StructField("speaker", T.IntegerType()),
        T.StructField("first_id", T.LongType()), T.StructField("last_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("apart", T.BooleanType()),
    ]
)
ARROW_PART = pa.schema([("kind", pa.int32()), ("pid", pa.int32()), ("pos", pa.int64()), ("conv", pa.string()), ("speaker", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_words", pa.int64()), ("apart", pa.bool_())])


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (conv, at, id, named, kept, words) in order -> parts of turns.

    A part is final unless its turn or its speaker may depend on a neighbouring
    partition: then it is an edge. The last row tells who was named last.
    """
    pid = TaskContext.get().partitionId()
    pos = 0
    conv = None  # of the lines so far, the last conversation; whether it is the partition's first; who was named last in it
    first_conv, named_last = True, -1
    open_turn: list | None = None  # [conv, speaker, first, last, words, edge, apart]
    seen_resolved = False  # a resolved turn of the partition's first conversation has begun

    for b in batches:
        if not b.num_rows:
            continue
        convs = b.column(0)
        key = codes(convs)
        fresh = run_starts(key)
        same = convs[0].as_py() == conv
        fresh[0] = not same
        ids, words = (np.asarray(b.column(i)).astype(np.int64) for i in (2, 5))
        named, kept = np.asarray(b.column(3).fill_null(-1)).astype(np.int64), np.asarray(b.column(4)).astype(bool)
        here = np.arange(len(ids))
        start = np.maximum.accumulate(np.where(fresh, here, -1))
        last_named = np.maximum.accumulate(np.where(named >= 0, here, -1))
        speaker = np.where((last_named >= 0) & (last_named >= start), named[last_named], -1)
        speaker = np.where((start == -1) & (speaker == -1), named_last, speaker)
        is_first = first_conv & (start == -1) | ((conv is None) & (np.cumsum(fresh) == 1))
        rows = np.flatnonzero(kept)
        out: list[list] = []
        if len(rows):
            begins = run_starts(np.cumsum(fresh)[rows], speaker[rows])
            at = np.flatnonzero(begins)
            ends = np.append(at[1:], len(rows)) - 1
            total = np.add.reduceat(words[rows], at)
            for k in range(len(at)):
                r = rows[at[k]]
                goes_on = k == 0 and open_turn is not None and start[r] == -1 and open_turn[:2] == [conv, speaker[r]]
                if goes_on:
                    open_turn[3], open_turn[4] = ids[rows[ends[k]]], open_turn[4] + total[k]
                    continue
                if open_turn is not None:
                    out.append(open_turn)
                edge = bool(is_first[r]) and (speaker[r] == -1 or not seen_resolved)
                seen_resolved |= bool(is_first[r]) and speaker[r] >= 0
                open_turn = [convs[int(r)].as_py(), int(speaker[r]), int(ids[r]), int(ids[rows[ends[k]]]), int(total[k]), edge, not edge]
        named_last = int(speaker[-1])
        first_conv = bool(is_first[-1])
        conv = convs[len(ids) - 1].as_py()
        if out:
            yield _part_batch(out, pid, pos)
            pos += len(out)
    if conv is not None:
        rest = []
        if open_turn is not None:
            open_turn[5] = open_turn[5] or open_turn[0] == conv
            rest.append(open_turn)
        rest.append([conv, named_last, None, None, None, None, False])
        yield _part_batch(rest, pid, pos)


def _part_batch(turns: list[list], pid: int, pos: int) -> pa.RecordBatch:
    rows = []
    for i, (conv, speaker, first, last, words, edge, apart) in enumerate(turns):
        kind = MARK_ROW if edge is None else EDGE if edge else FINAL
        rows.append({"kind": kind, "pid": pid, "pos": pos + i, "conv": conv, "speaker": None if speaker < 0 else speaker, "first_id": first, "last_id": last, "n_words": words, "apart": apart})
    return pa.RecordBatch.from_pylist(rows, schema=ARROW_PART)


def speaker_turns(lines: DataFrame, people: DataFrame, forms: Iterable[str]) -> DataFrame:
    """Clean, ordered turns of speakers 0 and 1.

    ``lines``: conv_id, raw_id, speaker, start_time, label, text, all but raw_id free
    strings; ``people``: conv_id, spk1, spk2, plain participant ids of speakers 0 and 1;
    ``forms``: basic forms of fillers. Lines go by start_time, then raw_id (an unreadable
    time comes last). Result: conv_id, speaker, first_raw_id, last_raw_id, n_words.
    Repeated rows count once; a line without conversation or id is left out, so
    is one before anybody is named. A conversation without a kept line has no turns.
    """
    filler = fillers(forms)
    rows = lines.where("conv_id is not null and raw_id is not null").select("conv_id", "raw_id", "speaker", "label", "text", clock_ms(F.col("start_time")).alias("at"))
    parsed_type = T.StructType([T.StructField("conv", T.StringType()), T.StructField("at", T.LongType()), T.StructField("id", T.LongType()), T.StructField("named", T.IntegerType()), T.StructField("person", T.StringType()), T.StructField("kept", T.BooleanType()), T.StructField("words", T.IntegerType())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = LineParser(filler)
        for b in batches:
            got = list(parser.lines(*(b.column(i).to_pylist() for i in (2, 3, 4))))
            columns = [b.column(0), b.column(5), b.column(1), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.string()), pa.array([not g[2] and g[3] > 0 for g in got], pa.bool_()), pa.array([g[3] for g in got], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, parsed_type.fieldNames())

    parsed = rows.mapInArrow(parse, parsed_type).distinct()
    who = people.select(F.col("conv_id").alias("conv"), "spk1", "spk2").dropDuplicates(["conv"])
    by_id = F.when(F.col("person") == F.col("spk1"), 0).when(F.col("person") == F.col("spk2"), 1)
    named = parsed.join(who, "conv", "left").select("conv", "at", "id", F.coalesce("named", by_id).alias("named"), "kept", "words")
    order = [F.col("conv"), F.col("at").asc_nulls_last(), F.col("id")]
    parts = checkpointed(named.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_turns, PART))

    edges = parts.where(F.col("kind") != FINAL)
    w = Window.partitionBy("conv").orderBy("pid", "pos")
    edges = edges.withColumn("speaker", F.coalesce("speaker", F.last("speaker", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    turns = edges.where((F.col("kind") == EDGE) & F.col("speaker").isNotNull())
    begins = F.when(F.col("apart") | ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w)), 1).otherwise(0)
    turns = turns.withColumn("begins", begins).withColumn("run", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("pid", "pos")
    joined = turns.groupBy("conv", "run").agg(F.first("speaker").alias("speaker"), F.min_by("first_id", place).alias("first_id"), F.max_by("last_id", place).alias("last_id"), F.sum("n_words").alias("n_words"))
    done = parts.where((F.col("kind") == FINAL) & F.col("speaker").isNotNull())
    columns = [F.col("conv").alias("conv_id"), "speaker", F.col("first_id").alias("first_raw_id"), F.col("last_id").alias("last_raw_id"), "n_words"]
    return done.select(*columns).unionByName(joined.select(*columns))


def participants(conversation: DataFrame) -> DataFrame:
    """conv_id, spk1, spk2: the plain ids of the participants that meta names."""
    return conversation.select(F.col("id").alias("conv_id"), *(participant_id(F.col("meta")[k]).alias(k) for k in ("spk1", "spk2"))).distinct()


CAPTION = T.StructType(
    [T.StructField("line_no", T.LongType()), T.StructField("speaker", T.StringType()), T.StructField("speaker_no", T.IntegerType()), T.StructField("start_time", T.StringType()), T.StructField("end_time", T.StringType()), T.StructField("text", T.StringType())]
)
TIMES_LINE = re.compile(rf"\s*({CLOCK})\s*-->\s*({CLOCK})")
VOICE_TAG = re.compile(r"^\s*<v(?:\.[\w.]+)?\s+([^>]+)>")
TIER_LINE = re.compile(r"\*([A-Za-z][A-Za-z0-9]{1,6}):\s*(.*)")
NAME_LINE = re.compile(r"([^\W\d_][\w .'’-]{0,40}?)\s*[:：](?!\d)\s*(.*)")
BULLET = re.compile(r"\x15(\d+)_(\d+)\x15")


def captions(text: str) -> list[list[str | None]]:
    """[speaker, start, end, text] of each cue or line of a file, by a finite-state pass over its lines.

    BETWEEN: blank lines, headers, cue numbers; SKIP: a header or comment block up to the next blank line; CUE: the text lines
    of a cue; SAID: a tier or named line, which indented lines carry on. Times are as written (tiers: milliseconds as seconds).
    """
    out: list[list[str | None]] = []
    state = "BETWEEN"
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    timed = any(TIMES_LINE.match(x) for x in lines)
    for no, line in enumerate(lines):
        if not line.strip():
            state = "BETWEEN"
        elif state == "SKIP":
            pass
        elif m := TIMES_LINE.match(line):
            out.append([None, m[1], m[2], ""])
            state = "CUE"
        elif state == "CUE":
            if v := VOICE_TAG.match(line):
                if out[-1][3]:  # a second voice in one cue
                    out.append([None, *out[-1][1:3], ""])
                out[-1][0], line = v[1].strip(), line[v.end() :]
            out[-1][3] = f"{out[-1][3]} {line.strip()}".strip()
        elif timed and (line.lstrip("\ufeff").startswith(("WEBVTT", "NOTE", "STYLE", "REGION"))):
            state = "SKIP"
        elif timed:
            pass  # the number or name of a cue
        elif line[0] in "@%":
            state = "BESIDE"
        elif line[0] in "\t " and state in ("SAID", "BESIDE"):
            if state == "SAID":
                out[-1][3] = f"{out[-1][3]} {line.strip()}"
        elif m := TIER_LINE.match(line) or NAME_LINE.match(line):
            out.append([m[1].strip(), None, None, m[2].strip()])
            state = "SAID"
        else:
            out.append([None, None, None, line.strip()])
            state = "SAID"
    for row in out:
        if b := BULLET.search(row[3]):
            row[1], row[2], row[3] = f"{int(b[1]) / 1000:.3f}", f"{int(b[2]) / 1000:.3f}", BULLET.sub("", row[3]).strip()
    return out


def caption_lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of whole files of captions or transcripts: ``key``, line_no (from 0), speaker, speaker_no, start_time, end_time, text.

    Layouts: subtitles with numbered cues, web captions with voice tags, tiers of ``*ABC:`` and ``NAME: text``. ``speaker`` is the name as
    written, ``speaker_no`` its place among the names of its file in order of first appearance, from 0. A line without times has nulls
    there, one without a name in the speaker columns. Null and blank files have no lines; further columns are ignored.
    """
    kind = files.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), *CAPTION.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                names: dict[str, int] = {}
                for no, (speaker, start, end, said) in enumerate(captions(t or "")):
                    number = names.setdefault(speaker.casefold(), len(names)) if speaker else None
                    rows.append((no, speaker, number, start, end, said))
                    at.append(i)
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns], schema.fieldNames())

    return files.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)
