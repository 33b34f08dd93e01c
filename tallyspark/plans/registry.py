"""Where plans register their queries together with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its name."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def rounded(names: list[str], digits: int = 6) -> str:
    """SQL select items that round."""
    return ", ".join(f"round({n}, {digits}) as {n}" for n in names)
