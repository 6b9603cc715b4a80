"""Queries by name and, beside each, SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("raster_queries", "vector_queries", "report_queries", "kernel_queries", "filter_queries")


def _all() -> dict:
    found = {}
    for name in MODULES:
        found |= import_module(f".{name}", __package__).QUERIES
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
