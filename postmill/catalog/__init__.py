"""Registered queries: each runs an operator over the given tables.

Every module lists `(name, query, sql)`; `sql` is the same result in ANSI SQL
for DuckDB, or None where SQL cannot express it.
"""
