"""All registered queries of the engine and their DuckDB oracles."""

from __future__ import annotations

from . import answer_queries, corpus_queries, graph_queries, markdown_queries, parse_queries, search_queries, store_queries, thai_queries  # noqa: F401
from .tables import ORACLE_SQL, QUERIES  # noqa: F401
