"""Queries over the given tables, one for each operator, and their DuckDB counterparts."""

from __future__ import annotations

from chatlake.jobs import history_queries, run_queries, stream_queries, text_queries, wire_queries

QUERIES = history_queries.QUERIES | run_queries.QUERIES | wire_queries.QUERIES | text_queries.QUERIES | stream_queries.QUERIES
ORACLE_SQL: dict[str, str] = history_queries.ORACLE_SQL | run_queries.ORACLE_SQL | wire_queries.ORACLE_SQL | text_queries.ORACLE_SQL | stream_queries.ORACLE_SQL
#: Queries without a counterpart.
WITHOUT_SQL = text_queries.WITHOUT_SQL
