"""Row filters, projections and per-row predicates.

Per-entity bounds (latest time, date range) are computed with a pre-aggregated
``groupBy`` and joined back, never with an unordered ``Window.partitionBy``:
a window would put a whole entity in one task, the aggregate puts one row per
entity and task into the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.scalar import (coerce_numeric_expr, relabel_expr, risk_band_expr,
                                        row_sum_expr)

# Lists up to this length become an ``IN`` literal; longer ones a semi join.
ISIN_MAX = 10_000
# A first-n id table is broadcast only when n is at most this (size proven by n).
BROADCAST_IDS_MAX = 1_000_000


def keep_entities(df: DataFrame, entity: str, ids) -> DataFrame:
    """Rows of the given entities. ``ids`` is a Python list (``IN`` literal,
    pushed to the Parquet scan) or a DataFrame with an ``entity`` column
    (left semi join; AQE chooses broadcast by the measured size)."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(entity).distinct(), entity, "left_semi")
    ids = list(ids)
    if len(ids) <= ISIN_MAX:
        return df.filter(F.col(entity).isin(ids))
    spark = df.sparkSession
    return df.join(spark.createDataFrame([(i,) for i in ids], [entity]), entity, "left_semi")


def first_n_entities(df: DataFrame, entity: str, n: int) -> DataFrame:
    """Rows of the ``n`` smallest entity ids. The id table holds at most ``n``
    rows, so it is broadcast when ``n`` is small enough."""
    ids = df.select(entity).distinct().orderBy(entity).limit(n)
    if n <= BROADCAST_IDS_MAX:
        ids = F.broadcast(ids)
    return df.join(ids, entity, "left_semi")


def recent_window(df: DataFrame, entity: str, ts: str, days: float) -> DataFrame:
    """Rows with ``ts >= max(ts of the entity) - days`` (inclusive)."""
    us = int(round(days * 86_400_000_000))
    last = df.groupBy(entity).agg(F.max(ts).alias("_tmax"))
    cut = F.timestamp_micros(F.unix_micros(F.col("_tmax")) - F.lit(us))
    return df.join(last, entity, "inner").filter(F.col(ts) >= cut).drop("_tmax")


def date_range(df: DataFrame, entity: str, ts: str, start=None, end=None, default_days: int = 7) -> DataFrame:
    """Rows whose calendar date lies in ``[start, end]`` (inclusive). Missing
    bounds default per entity: ``end`` = last date, ``start`` = date of
    ``max(first ts, last ts - default_days)``."""
    b = df.groupBy(entity).agg(F.min(ts).alias("_t0"), F.max(ts).alias("_t1"))
    d = df.join(b, entity, "inner")
    return d.filter(in_date_range(ts, start, end, default_days)).drop("_t0", "_t1")


def in_date_range(ts: str, start=None, end=None, default_days: int = 7) -> Column:
    """The condition of ``date_range`` for rows that hold their entity's first
    and last time as ``_t0`` and ``_t1``."""
    back = F.timestamp_micros(F.unix_micros(F.col("_t1")) - F.lit(default_days * 86_400_000_000))
    lo = F.to_date(F.lit(start)) if start is not None else F.to_date(F.greatest(F.col("_t0"), back))
    hi = F.to_date(F.lit(end)) if end is not None else F.to_date(F.col("_t1"))
    return F.to_date(F.col(ts)).between(lo, hi)


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL (or NaN) in any of ``subset`` (default: all columns)."""
    return df.dropna("any", subset=list(subset) if subset else None)


def coerce_numeric(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Text cells -> double; unparsable text becomes NULL."""
    for c in cols:
        df = df.withColumn(c, coerce_numeric_expr(c))
    return df


def risk_band(df: DataFrame, score: str = "risk_score", medium: float = 0.4, high: float = 0.7,
              out: str = "risk_band") -> DataFrame:
    return df.withColumn(out, risk_band_expr(score, medium, high))


def relabel(df: DataFrame, col: str, mapping: Mapping[str, str], out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, relabel_expr(col, mapping))


def row_sum(df: DataFrame, cols: Sequence[str], out: str = "total") -> DataFrame:
    return df.withColumn(out, row_sum_expr(cols))


def narrow_types(df: DataFrame, float_cols: Sequence[str] = (), short_cols: Sequence[str] = ()) -> DataFrame:
    """float32 signals and narrow ids for compact sinks (the engine computes in
    double/long). An id column becomes int16 if all its values fit, else int32
    if they fit, else it keeps its type (one aggregate over ``short_cols``)."""
    for c in float_cols:
        df = df.withColumn(c, F.col(c).cast("float"))
    if short_cols:
        most = df.agg(*[F.max(F.greatest(F.col(c).cast("long"), -F.col(c).cast("long") - 1)).alias(c)
                        for c in short_cols]).first()
        for c in short_cols:
            kind = next((k for k, top in (("smallint", 2 ** 15), ("int", 2 ** 31)) if (most[c] or 0) < top), None)
            df = df.withColumn(c, F.col(c).cast(kind)) if kind else df
    return df
