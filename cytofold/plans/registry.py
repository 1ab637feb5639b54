"""A small registry: a query and its SQL are declared side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracles[f.__name__] = sql
            return f

        return add


def rounded(df, digits: int = 6, skip: tuple[str, ...] = ()):
    """Doubles rounded for comparison with another engine."""
    return df.withColumns({n: F.round(n, digits) for n, t in df.dtypes if t == "double" and n not in skip})


def settled(name: str, digits: int = 6):
    """A double rounded as a decimal, so that exact ties go up in every engine."""
    return F.round(F.col(name).cast("decimal(28,9)"), digits).cast("double")
