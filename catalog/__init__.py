"""Registered queries over the given tables, with the SQL that checks them."""

from catalog import cleaning_queries, feature_queries, ingest_queries, job_queries  # noqa: F401
from catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
