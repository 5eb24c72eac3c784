"""All catalogue queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from . import catalog_queries, feed_queries, matching_queries, template_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (catalog_queries, feed_queries, matching_queries, template_queries):
    QUERIES |= _module.Q.queries
    ORACLES |= _module.Q.oracles
