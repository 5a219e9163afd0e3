"""Registered queries: name -> Spark plan, and where SQL can say it, the oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .fixtures import Tables, with_views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        assert name not in QUERIES, name
        QUERIES[name] = Query(name, fn, sql)
        return fn
    return deco


def runnable() -> dict[str, Callable]:
    return {n: (lambda spark, sf_dir, q=q: q.build(Tables(spark, sf_dir))) for n, q in QUERIES.items()}


def oracles() -> dict[str, str]:
    return {n: with_views(q.sql) for n, q in QUERIES.items() if q.sql}
