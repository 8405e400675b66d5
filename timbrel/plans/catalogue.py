"""All registered queries of the core and their SQL."""

from __future__ import annotations

from timbrel.plans import chunked, deliveries, feeds, records, relational, textual

MODULES = [deliveries, relational, textual, chunked, feeds, records]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
