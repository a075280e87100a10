"""The list of runnable queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoloom.plans.views import Views, view_sql
from geoloom.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_VIEWS: dict[tuple[str, str], Views] = {}


def views_of(spark: SparkSession, folder: str) -> Views:
    """The views of a folder, landed once in an application and read again by later queries."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _VIEWS:
        _VIEWS[key] = Views(spark, folder)
    _VIEWS[key].spark = prepare(spark)
    return _VIEWS[key]


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a function of ``Views`` under an operator's name, with the SQL that must agree with it."""

    def wrap(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, folder: fn(views_of(spark, folder))
        if sql is not None:
            prefix = view_sql(views)
            if prefix and sql.startswith("WITH RECURSIVE "):
                text = "WITH RECURSIVE " + prefix[len("WITH "):].rstrip() + ", " + sql[len("WITH RECURSIVE "):]
            elif prefix and sql.startswith("WITH "):
                text = prefix.rstrip() + ", " + sql[len("WITH "):]
            else:
                text = prefix + sql
            ORACLES[name] = text
        return fn

    return wrap
