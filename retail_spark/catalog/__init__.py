"""Registered queries: one Spark callable and (where SQL can say it) one
independent DuckDB statement per operator of the inventory.

A registration binds a library operator to the fixture tables and its
parameters.  The SQL twin is written separately, by hand, against the raw
tables; the canonical views it names are prefixed as CTEs automatically.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from retail_spark.sources.tables import VIEW_DEPS, VIEW_SQL, Tables

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}

MODULES = ("reporting", "relational", "eda", "segments", "timeseries",
           "recommend", "anomaly", "inventory", "models", "files", "streams")


def _views_in(sql: str) -> list[str]:
    found: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEW_DEPS.get(name, []):
            visit(dep)
        if name not in found:
            found.append(name)

    for name in VIEW_SQL:
        if re.search(rf"\b{name}\b", sql):
            visit(name)
    return found


def with_views(sql: str) -> str:
    """Prefix the canonical views the statement names as CTEs."""
    names = _views_in(sql)
    if not names:
        return sql.strip()
    body = sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n].strip()})" for n in names)
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"


def register(name: str, sql: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` under ``name``."""

    def deco(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if sql is not None:
            _ORACLES[name] = with_views(sql)
        return fn

    return deco


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"retail_spark.catalog.{m}")


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
