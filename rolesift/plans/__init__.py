"""Derived tables and the query registry."""

from . import queries as _queries

QUERIES = _queries.QUERIES
