"""Registry of demonstration queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from perfspark.plans.views import SQL_VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None, **steps: str):
    """Register ``fn(spark, sf_dir)`` under ``name``.

    ``views`` names the domain views the SQL needs, ``steps`` are further
    common table expressions in order, ``sql`` is the final select.
    """

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            parts = [f"{v} AS ({SQL_VIEWS[v]})" for v in views.split()]
            parts += [f"{step} AS ({body})" for step, body in steps.items()]
            ORACLES[name] = ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + sql
        return fn

    return register
