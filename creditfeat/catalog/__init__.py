"""Every query the engine registers, with the SQL that must give the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Collects queries of one subject; ``sql`` is the equivalent for the oracle."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            self.queries[fn.__name__] = fn
            if sql is not None:
                self.oracles[fn.__name__] = sql
            return fn

        return register


def _subjects() -> list[Catalog]:
    from creditfeat.catalog import encoding, files, leakfree, models, neighbours, preparing, profiling, scoring

    return [m.CATALOG for m in (files, preparing, profiling, scoring, encoding, neighbours, leakfree, models)]


def queries() -> dict[str, Query]:
    return {n: q for s in _subjects() for n, q in s.queries.items()}


def oracles() -> dict[str, str]:
    return {n: q for s in _subjects() for n, q in s.oracles.items()}
