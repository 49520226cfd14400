"""Registry of named queries and their SQL oracles.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
supplied tables. Its oracle (when the semantics are SQL-expressible) is a
DuckDB query over the same Parquet tables, written independently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import oracle

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None, views: tuple[str, ...] | list[str] = ()):
    def deco(fn: Query) -> Query:
        if key in QUERIES:
            raise KeyError(f"query {key!r} registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = oracle.with_views(list(views), sql)
        return fn

    return deco


def flat(df: DataFrame) -> DataFrame:
    """Arrays of strings -> comma-joined text, for engine-neutral comparison."""
    exprs = []
    for f in df.schema.fields:
        name = f"`{f.name}`"
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            exprs.append(f"array_join({name}, ',') AS {name}")
        else:
            exprs.append(name)
    return df.selectExpr(*exprs)


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib

    for name in ("q_insights", "q_classify", "q_triage", "q_quality", "q_metrics", "q_sources", "q_streaming", "q_store"):
        importlib.import_module(f"{__package__}.{name}")
