"""The core queries in SQL, by name."""

from __future__ import annotations

from .queries import MODULES


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
