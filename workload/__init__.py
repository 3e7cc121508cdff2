"""Checked queries: every operator run over the given tables, with its SQL oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under ``name`` with its oracle."""
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return wrap


def load_all() -> None:
    from . import (aggregates, arrays, asof, catalog, detections, geometry, hard,  # noqa: F401
                   intervals, joins, localization, names, times, windows)
