"""All registered queries and their oracle SQL."""

from __future__ import annotations

from . import queries_books, queries_html, queries_layout, queries_pages, queries_text

MODULES = (queries_text, queries_html, queries_books, queries_layout, queries_pages)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
