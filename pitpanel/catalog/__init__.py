"""Queries over the supplied tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pitpanel.catalog import calendars, checks, evaluation, feeds, gates, inference, lookups, spatial, walkforward
from pitpanel.catalog.base import Query

MODULES = (gates, calendars, lookups, spatial, evaluation, walkforward, inference, feeds, checks)


def catalog() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in MODULES:
        for query in module.QUERIES:
            if query.name in found:
                raise ValueError(f"duplicate query name {query.name}")
            found[query.name] = query
    return found
