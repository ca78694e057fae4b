"""Personal baselines: entity statistics, z-scores, the one-row event flag."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.scalar import any_exceeds_expr, safe_div


def entity_stats(df: DataFrame, entity: str, signals: Sequence[str], ddof: int = 1) -> DataFrame:
    """Per entity: ``<sig>_mean`` and ``<sig>_std`` (sample std for ``ddof=1``,
    population for ``ddof=0``). One hash aggregate with map-side partials, so a
    hot entity is pre-reduced in every task before the shuffle."""
    std = F.stddev_samp if ddof == 1 else F.stddev_pop
    aggs = []
    for s in signals:
        x = F.col(s).cast("double")
        aggs += [F.avg(x).alias(f"{s}_mean"), std(x).alias(f"{s}_std")]
    return df.groupBy(entity).agg(*aggs)


def attach_stats(df: DataFrame, stats: DataFrame, entity: str) -> DataFrame:
    """Left equi-join of per-entity statistics onto every row.

    No broadcast hint: the stats side has one row per entity, which is small for
    a few thousand entities but not bounded in general. AQE measures the
    materialised stats at run time and turns the join into a broadcast hash
    join only under ``spark.sql.adaptive.autoBroadcastJoinThreshold``; above it
    the sort-merge join stays, with skew-join splitting for a hot entity.
    """
    return df.join(stats, on=entity, how="left")


def attach_group_agg(df: DataFrame, entity: str, aggs: Mapping[str, Column]) -> DataFrame:
    """pandas ``groupby().transform``: attach per-entity aggregates to each row.

    Written as aggregate + join instead of an unordered ``Window.partitionBy``,
    which would hold a whole entity in one task; the values are the same.
    """
    g = df.groupBy(entity).agg(*[expr.alias(name) for name, expr in aggs.items()])
    return df.join(g, on=entity, how="left")


def zscore(df: DataFrame, entity: str, signals: Sequence[str], stats: DataFrame | None = None,
           suffix: str = "_zscore", keep_stats: bool = False) -> DataFrame:
    """``(x - mean) / std`` per entity; a zero or missing std gives NULL."""
    if stats is None:
        stats = entity_stats(df, entity, signals)
    d = attach_stats(df, stats, entity)
    for s in signals:
        d = d.withColumn(f"{s}{suffix}", safe_div(F.col(s) - F.col(f"{s}_mean"), F.col(f"{s}_std")))
    if not keep_stats:
        d = d.drop(*[f"{s}_{k}" for s in signals for k in ("mean", "std")])
    return d


def any_exceeds(df: DataFrame, cols: Sequence[str], threshold: float = 2.0,
                out: str = "risk_event_now") -> DataFrame:
    """``out`` = any ``|c| > threshold`` (NULL counts as not exceeding)."""
    return df.withColumn(out, any_exceeds_expr(cols, threshold))
