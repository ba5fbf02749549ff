"""Named queries: a function of the bound tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.plans.bindings import CTES, Bound

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def with_tables(names: str, select: str) -> str:
    """select with the common table expressions that it names, and those that they need."""
    needed: list[str] = []

    def add(name: str) -> None:
        if name not in needed:
            for other in CTES[name][0].split():
                add(other)
            needed.append(name)

    for name in names.split():
        add(name)
    parts = ", ".join(f"{n} AS ({CTES[n][1]})" for n in needed)
    if not parts:
        return select
    if select.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {parts}, {select.lstrip()[len('WITH RECURSIVE') :]}"
    if select.lstrip().upper().startswith("WITH"):
        return f"WITH {parts}, {select.lstrip()[len('WITH') :]}"
    return f"WITH {parts} {select}"


def query(name: str, tables: str = "", sql: str | None = None) -> Callable:
    """Register a function of Bound as a query; sql reads the named bindings."""

    def add(f: Callable[[Bound], DataFrame]) -> Callable[[Bound], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, sf_dir: f(Bound(spark, sf_dir))
        if sql:
            ORACLE[name] = with_tables(tables, sql)
        return f

    return add
