"""Queries over the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under `name`, with optional SQL."""

    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def rounded(c: Column | str, digits: int) -> Column:
    """`c` rounded as SQL's round does it for doubles: scaled up, rounded to a whole number, scaled down.

    Spark's own round looks at the decimal form instead, so halves such as 0.0628125 may
    fall to the other side.
    """
    scale = F.lit(10.0**digits)
    return F.round((F.col(c) if isinstance(c, str) else c) * scale) / scale


def load_all() -> None:
    from checks import (  # noqa: F401
        aggregates,
        boxes,
        hooks,
        joins,
        labels,
        sampling,
        sources,
        streams,
        vectors,
    )
