"""Registered queries of the core operators, with their SQL beside them."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "split_stats"

#: Common table expressions that the SQL of several queries starts with.
RECORDS_SQL = "rec AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY retrieved_at::TIMESTAMPTZ DESC) AS rn FROM astronomy_sample WHERE document_id IS NOT NULL) WHERE rn = 1)"


def query(sql: str | None = None):
    """Register the function under its name; sql is its equivalent in DuckDB's dialect."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def load() -> None:
    """Import all modules that register queries."""
    from skein.plans import audit_queries, corpus_queries, graph_queries, token_queries  # noqa: F401
