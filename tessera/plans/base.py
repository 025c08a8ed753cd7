"""How queries are registered: a function of (spark, sf_dir), and SQL over the same tables."""

from __future__ import annotations

from .views import SQL

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None, views: str = ""):
    """Register a query; sql goes on after the common table expressions of the named views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            parts = [f"{v} as ({SQL[v]})" for v in views.split()]
            body = sql.strip()
            head = "with recursive " if parts or body.startswith(",") else ""
            ORACLE_SQL[f.__name__] = f"{head}{', '.join(parts)}\n{body if parts else body.lstrip(',')}"
        return f

    return add
