"""Registered queries: a Spark callable, the inventory ids it covers, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from turnout.session import configure
from turnout.sources.adapters import Views, oracle


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple
    build: Callable[[Views], DataFrame]
    sql: str | None

    def run(self, spark, folder) -> DataFrame:
        return self.build(Views(configure(spark), folder))

    def oracle(self) -> str | None:
        return oracle(self.sql) if self.sql else None


QUERIES: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register ``build(views)`` under ``name``; ``ids`` are the inventory ids it covers."""
    def add(build):
        assert name not in QUERIES, name
        QUERIES[name] = Query(name, tuple(ids.split()), build, sql)
        return build
    return add
