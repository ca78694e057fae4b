"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitalgrid.functions.scalar import round_doubles

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        text = sql
        if text is not None and not text.lstrip().upper().startswith(("WITH", "SELECT")):
            text = "WITH " + text.lstrip()
        REGISTRY[name] = (fn, text)
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double/float column to ``digits`` places (oracle comparisons)."""
    return round_doubles(df, digits)
