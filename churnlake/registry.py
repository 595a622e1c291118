"""Query registry: name -> (Spark callable, DuckDB oracle SQL or None).

Each callable takes ``(spark, sf_dir)``, reads the driver's tables and
returns a DataFrame (never collected here). Computed doubles that come
from floating sums or transcendental functions are rounded to 6 decimals
on both sides, so that summation order does not decide equality.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise KeyError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn
    return deco


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f.name) for f in df.schema.fields])


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)


_LOADED = False


def _load():
    global _LOADED
    if not _LOADED:
        _LOADED = True
        from churnlake import queries as _q  # noqa: F401  (registers on import)
