"""The labelled feature table: personal z-scores, trends, event flags and the
look-ahead label, composed from the baseline and sequence operators.

All ordered steps share one per-entity row index (``sequence.row_index``);
the trend, the sustained flag and the look-ahead label then run in a single
(entity, chunk) exchange (``sequence.trend_and_label``): two data shuffles in
all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.operators import baselines as B
from vitalgrid.operators import sequence as S


def build_features(df: DataFrame, entity: str, order: Sequence[str], signals: Sequence[str],
                   z_threshold: float = 2.0, trend_rows: int | None = 60, horizon: int = 720,
                   sustained_rows: int | None = None, stats: DataFrame | None = None,
                   label: str = "target_future_risk", chunk_rows: int = S.DEFAULT_CHUNK_ROWS,
                   bucket: str = "day", rn: str | None = None) -> DataFrame:
    """Panel -> feature table with ``<sig>_zscore``, ``<sig>_zscore_trend``
    (mean of the last ``trend_rows`` rows), ``risk_event_now`` (any |z| above
    the threshold), optionally ``sustained_event`` (``sustained_rows`` flagged
    rows in a row) and ``label`` (an event within the next ``horizon`` rows,
    current row included). ``stats`` defaults to all history of all entities.
    ``bucket``: time unit of the row-numbering pieces (``sequence.row_index``);
    ``rn``: an existing 1-based per-entity row number (e.g. from ``clean_panel``
    on a regular grid) — then no numbering pass runs and the column is kept."""
    order = list(order)
    z = B.zscore(df, entity, signals, stats=stats)
    zc = [f"{s}_zscore" for s in signals]
    z = B.any_exceeds(z, zc, z_threshold)
    rcol = rn or S.RN
    if rn is None:
        z = S.row_index(z, entity, order, bucket=bucket)
    # trend, run length and look-ahead share one (entity, chunk) exchange
    z = S.trend_and_label(z, entity, rcol, zc, trend_rows, "risk_event_now", horizon, label=label,
                          sustained_rows=sustained_rows, chunk_rows=chunk_rows)
    return z if rn else z.drop(S.RN)


def feature_columns(signals: Sequence[str], trend: bool = True) -> list[str]:
    """raw + z (+ trend) feature names in the reference order."""
    cols = list(signals) + [f"{s}_zscore" for s in signals]
    if trend:
        cols += [f"{s}_zscore_trend" for s in signals]
    return cols


def derived_columns(signal: str) -> list[str]:
    """A signal and every feature derived from it (for ablation)."""
    return [signal, f"{signal}_zscore", f"{signal}_zscore_trend"]


def impute_entity_mean(df: DataFrame, entity: str, signals: Sequence[str]) -> DataFrame:
    """Missing cells of raw signals -> the entity's mean, where its z-score
    is 0 (a signal the entity never has stays NULL). One row per entity is
    joined back."""
    means = df.groupBy(entity).agg(*[F.avg(F.col(s).cast("double")).alias(f"_mean_{s}") for s in signals])
    d = df.join(means, entity, "left")
    return d.withColumns({s: F.coalesce(F.col(s), F.col(f"_mean_{s}")) for s in signals}).drop(
        *[f"_mean_{s}" for s in signals])


def fill_features(df: DataFrame, cols: Sequence[str], value: float = 0.0) -> DataFrame:
    """Missing feature cells (z of a constant signal, no history) -> ``value``."""
    return df.fillna(value, subset=list(cols)).select(
        *[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])
