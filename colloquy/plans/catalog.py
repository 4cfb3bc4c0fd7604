"""All queries of the core and their SQL."""

from __future__ import annotations

from colloquy.plans import coverage, evaluation, events, extras, frames, interleave, scoring, signal, sources, stats, text, training, windows

MODULES = (events, frames, stats, windows, interleave, text, scoring, signal, sources, extras, training, evaluation)
QUERIES = {"p4_found": coverage.p4_found}
SQL = {"p4_found": coverage.P4_SQL}
for m in MODULES:
    QUERIES.update(m.QUERIES)
    SQL.update(m.SQL)
