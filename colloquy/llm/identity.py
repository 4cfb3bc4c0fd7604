"""Ids that are written in many ways, and values that only stand in for a missing one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def folded(c: Column) -> Column:
    """Lower case, ordinary width, letters and digits only (of any script)."""
    return F.regexp_replace(F.lower(F.translate(c, WIDE, PLAIN)), r"[^\p{L}\p{N}]", "")


def id_key(c: Column) -> Column:
    """``letters:number`` of an id like ``P0000012``, `` p_12`` or ``oto-0000106``; else null.

    What has no letters in front or no digits behind them is a stand-in and names nothing.
    """
    f = folded(c)
    return F.when(f.rlike(r"^[a-z]+[0-9]+$"), F.concat_ws(":", F.regexp_extract(f, r"^([a-z]+)", 1), F.regexp_extract(f, r"0*([0-9]+)$", 1)))


def participant_id(c: Column) -> Column:
    """The plain form of a participant's id: P and seven digits (more if there are more); else null."""
    number = F.regexp_extract(folded(c), r"^p0*([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("P"), F.when(F.length(number) < 7, F.lpad(number, 7, "0")).otherwise(number)))
