"""All queries of the core, and their SQL."""

from __future__ import annotations

from ledgerlens.plans import pipeline, problems, search, store_queries, tables_queries, vector_queries

QUERIES = {**tables_queries.QUERIES, **vector_queries.QUERIES, **pipeline.QUERIES, **search.QUERIES, **store_queries.QUERIES, **problems.QUERIES}
SQL = {**tables_queries.SQL, **vector_queries.SQL, **problems.SQL, **store_queries.SQL}
