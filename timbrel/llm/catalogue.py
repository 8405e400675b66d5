"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from timbrel.llm import budget, leaks, lookalike, packing, reading, runs, splitting, turns

MODULES = [splitting, budget, lookalike, runs, turns, packing, leaks, reading]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
