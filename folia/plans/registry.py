"""Queries and SQL of the reference's operators, by name."""

from __future__ import annotations

from folia.plans import article_queries, job_queries, stream_queries, table_queries, text_queries

QUERIES: dict = text_queries.QUERIES | table_queries.QUERIES | article_queries.QUERIES | job_queries.QUERIES | stream_queries.QUERIES
SQL: dict = text_queries.SQL | table_queries.SQL | article_queries.SQL | job_queries.SQL | stream_queries.SQL
