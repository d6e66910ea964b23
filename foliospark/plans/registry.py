"""Registered queries and their oracle SQL, collected from the modules of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its own name, with the SQL that gives the same rows."""

    def add(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if oracle is not None:
            _ORACLES[fn.__name__] = oracle
        return fn

    return add


def _load() -> None:
    import importlib
    import pkgutil

    from foliospark import plans

    for module in pkgutil.iter_modules(plans.__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"foliospark.plans.{module.name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
