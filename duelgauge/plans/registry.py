"""Registry of named queries and the plain SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_TABLES: dict[str, tuple[tuple[str, ...], str]] = {}


def table(name: str, needs: str, body: str) -> None:
    """Declare a shared SQL table expression; `needs` lists the ones it reads."""
    _TABLES[name] = (tuple(needs.split()), body)


def with_tables(needs: str, body: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for parent in _TABLES[name][0]:
            visit(parent)
        ordered.append(name)

    for name in needs.split():
        visit(name)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({_TABLES[n][1]})" for n in ordered) + "\n" + body


def query(name: str, needs: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_tables(needs, sql)
        return fn

    return add
