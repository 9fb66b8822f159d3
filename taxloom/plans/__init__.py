"""Registered queries over the given tables, with their SQL."""

from taxloom.plans import documents, queries, reports, runs, scalars, texts, wide  # noqa: F401

ALL_QUERIES = queries.QUERIES
ALL_SQL = queries.SQL
