"""A table of named queries with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict[str, tuple[Callable, str | None]], Callable]:
    table: dict[str, tuple[Callable, str | None]] = {}

    def query(sql: str | None = None, name: str | None = None):
        def add(f):
            table[name or f.__name__] = (f, sql)
            return f

        return add

    return table, query


def rounded(df, digits: int = 6, **own: int):
    """Doubles rounded (and minus zero made zero), so that sums in any order compare equal."""
    from pyspark.sql import functions as F

    return df.select(*[(F.round(F.col(c), own.get(c, digits)) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
