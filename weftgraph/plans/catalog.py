"""Registered queries over the reference's own operators, and SQL that gives the same rows."""

from __future__ import annotations

from weftgraph.plans import code_queries, cypher_queries, detail_queries, graph_queries, review_queries

_MODULES = (cypher_queries, graph_queries, code_queries, review_queries, detail_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
