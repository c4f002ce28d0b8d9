"""All registered queries of the library's own operators."""

from __future__ import annotations

from larkspan.plans import dialogue_queries, graph_queries, rollup_queries, search_queries, source_queries, text_queries

_MODULES = (search_queries, rollup_queries, text_queries, graph_queries, dialogue_queries, source_queries)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
