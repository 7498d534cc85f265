"""All queries of the core, and the SQL each is checked against."""

from __future__ import annotations

from setweave.plans import entity_queries, evaluation_queries, expansion_queries, proximity_queries, ranking_queries, small_files, source_queries, streaming_queries, text_queries

MODULES = [small_files, text_queries, ranking_queries, entity_queries, expansion_queries, source_queries, proximity_queries, evaluation_queries, streaming_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
