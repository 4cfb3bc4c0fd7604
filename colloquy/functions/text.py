"""Text normalisation, written times and error rates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; only what isn't ASCII is touched."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def normalize_ascii(c: Column) -> Column:
    """Tags of up to 20 characters dropped, lower case, signs that are no word characters to one space, ends trimmed."""
    plain = F.lower(F.regexp_replace(c, "<[^>]{1,20}>", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def normalize_text(c: Column, lang: Column) -> Column:
    """Normal form for scoring; Korean loses its spaces. Null stays null."""
    composed = F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(nfkc(c))
    n = normalize_ascii(composed)
    return F.when(lang == "ko", F.replace(n, F.lit(" "))).otherwise(n)


def word_edits(ref: Column, hyp: Column) -> Column:
    """Edit distance of two arrays of words: a fold over the hypothesis that carries one row of the table."""
    start = F.transform(F.sequence(F.lit(0), F.size(ref)), lambda i: i)

    def row(prev: Column, h: Column) -> Column:
        def cell(acc: Column, i: Column) -> Column:
            cost = F.when(F.element_at(ref, i) == h, 0).otherwise(1)
            return F.array_append(acc, F.least(F.element_at(acc, -1) + 1, F.element_at(prev, i + 1) + 1, F.element_at(prev, i) + cost))

        return F.aggregate(F.sequence(F.lit(1), F.size(ref)), F.array(F.element_at(prev, 1) + 1), cell)

    table = F.aggregate(hyp, start, row)
    return F.when(F.size(ref) == 0, F.size(hyp)).when(F.size(hyp) == 0, F.size(ref)).otherwise(F.element_at(table, -1))


# Spacing, as Java and as RE2 write it.
SPACES = r"[\t-\r\x1c-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
SPACES_SQL = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def stripped(c: Column) -> Column:
    """Without spacing of any kind at either end."""
    return F.regexp_replace(c, rf"^{SPACES}+|{SPACES}+$", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def clock_ms(c: F.Column) -> F.Column:
    """Milliseconds of ``H:M:S``, ``M:S`` or seconds, with a point or comma before the fraction and commas between thousands; else null."""
    s = F.regexp_replace(F.trim(c), r"\s|s$", "")
    clock = r"^(?:([0-9]+):)?([0-9]+):([0-9]+(?:[.,][0-9]+)?)$"
    sec = F.regexp_replace(F.regexp_extract(s, clock, 3), ",", ".").cast("decimal(20,6)")
    of_clock = (F.when(F.regexp_extract(s, clock, 1) != "", F.regexp_extract(s, clock, 1)).otherwise("0").cast("bigint") * 60 + F.regexp_extract(s, clock, 2).cast("bigint")) * 60 + sec
    grouped = r"^[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"
    of_seconds = F.when(s.rlike(grouped), F.regexp_replace(s, ",", "")).otherwise(F.regexp_replace(s, ",", ".")).cast("decimal(26,6)")
    value = F.when(s.rlike(clock), of_clock).when(s.rlike(r"^[0-9]+([.,][0-9]+)*$") & (s.rlike(grouped) | s.rlike(r"^[0-9]+([.,][0-9]+)?$")), of_seconds)
    return F.round(value * 1000).cast("bigint")
