"""All registered queries of the engine's own operators."""

from __future__ import annotations

from auditmill.plans import code_queries, ingest_queries, result_queries, search_queries, visit_queries

MODULES = (search_queries, code_queries, visit_queries, ingest_queries, result_queries)


def queries() -> dict:
    return {name: query for module in MODULES for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
