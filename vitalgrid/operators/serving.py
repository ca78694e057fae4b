"""Serving-side operators: latest row, bins, leading factors, bands, alerts,
entity summaries and the trend view.

Everything per entity is a hash aggregate with map-side partials (``max_by``,
``avg``, ``min``/``max``) joined back where rows need it, so a hot entity is
reduced inside every map task before the shuffle and no task holds a whole
entity.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.scalar import risk_band_expr, safe_div
from vitalgrid.operators.grid import step_micros

# The alert threshold and the risk bands of the dashboard.
RISK_HIGH = 0.7
RISK_MEDIUM = 0.4

# Readable names of the wearable signals.
READABLE_NAMES = {
    "heart_rate": "Heart Rate", "heart_rate_variability": "Heart Rate Variability",
    "spo2": "SpO2", "steps": "Steps", "respirations_per_minute": "Respiration Rate",
    "distance": "Distance", "body_battery": "Body Battery",
}


def _order_key(ts: str, tie: Sequence[str] = ()) -> Column:
    return F.struct(F.col(ts), *[F.col(t) for t in tie])


def latest_row(df: DataFrame, entity, ts: str, required: Sequence[str] | None = None,
               tie: Sequence[str] = ()) -> DataFrame:
    """The last row of each entity by ``ts`` (then ``tie``). With ``required``:
    if that row has a NULL in a required column, the last complete row instead;
    entities with no complete row are left out. One ``max_by`` aggregate, no sort."""
    keys = [entity] if isinstance(entity, str) else list(entity)
    row = F.struct(*[F.col(c) for c in df.columns])
    key = _order_key(ts, tie)
    if required:
        complete = F.lit(True)
        for c in required:
            complete = complete & F.col(c).isNotNull()
        key = F.struct(complete.alias("_ok"), key.alias("_k"))
        picked = df.groupBy(*keys).agg(F.max_by(row, key).alias("_r"), F.max(complete).alias("_any_ok"))
        return picked.filter(F.col("_any_ok")).select("_r.*")
    return df.groupBy(*keys).agg(F.max_by(row, key).alias("_r")).select("_r.*")


def bin_start(ts: str, bin_size: str | int) -> Column:
    """Start of the fixed ``bin_size`` bin holding ``ts``, aligned to the epoch
    (= midnight for bins that divide a day)."""
    us = step_micros(bin_size)
    return F.timestamp_micros(F.floor(F.unix_micros(F.col(ts)) / F.lit(us)).cast("long") * F.lit(us))


def bin_series(df: DataFrame, entity: str, ts: str, cols: Sequence[str], bin_size: str = "15 minutes",
               out_ts: str | None = None) -> DataFrame:
    """Mean of each column per entity and bin (bins without rows do not appear)."""
    return (df.groupBy(entity, bin_start(ts, bin_size).alias(out_ts or ts))
              .agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]))


def downsample(df: DataFrame, entity: str, ts: str, bin_size: str, numeric: Sequence[str],
               categorical: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Per entity and bin: mean of ``numeric``, last non-NULL value of each
    ``categorical`` column; bins with a NULL in any output column are dropped."""
    key = _order_key(ts, tie)
    aggs = [F.avg(F.col(c).cast("double")).alias(c) for c in numeric]
    aggs += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), key)).alias(c) for c in categorical]
    out = df.groupBy(entity, bin_start(ts, bin_size).alias(ts)).agg(*aggs)
    return out.dropna("any")


def top_k_factors(df: DataFrame, zcols: Mapping[str, str], weights: Mapping[str, float], k: int = 3,
                  names: Mapping[str, str] | None = None, prefix: str = "top_factor_") -> DataFrame:
    """Rank signals within each row by ``weight * |z|`` (largest first); a
    missing z ranks last; ties keep the signal order. Adds ``<prefix>1..k`` with
    readable names. ``zcols`` maps signal -> z-score column, in signal order."""
    sigs = list(zcols)
    names = names or READABLE_NAMES
    items = []
    for i, s in enumerate(sigs):
        contrib = F.lit(float(weights[s])) * F.abs(F.col(zcols[s]).cast("double"))
        # missing contribution -> key +1, after every real key (keys are <= 0)
        items.append(F.struct(F.coalesce(-contrib, F.lit(1.0)).alias("key"), F.lit(i).alias("idx"),
                              F.lit(names.get(s, s)).alias("name")))
    ranked = F.slice(F.array_sort(F.array(*items)), 1, k)
    out = df.withColumn("_rk", ranked)
    for j in range(min(k, len(sigs))):
        out = out.withColumn(f"{prefix}{j + 1}", F.col("_rk")[j]["name"])
    return out.drop("_rk")


def signal_card(df: DataFrame, entity: str, ts: str, signals: Sequence[str], digits: int = 2,
                tie: Sequence[str] = ()) -> DataFrame:
    """Per entity and signal: mean, sample std and last value, rounded; long format."""
    key = _order_key(ts, tie)
    aggs = []
    for s in signals:
        x = F.col(s).cast("double")
        aggs += [F.avg(x).alias(f"{s}__mean"), F.stddev_samp(x).alias(f"{s}__std"),
                 F.max_by(x, key).alias(f"{s}__last")]
    wide = df.groupBy(entity).agg(*aggs)
    parts = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(f"{s}__mean").alias("mean"),
                               F.col(f"{s}__std").alias("std"), F.col(f"{s}__last").alias("last_value"))
                      for s in signals])
    long = wide.select(entity, F.inline(parts))
    return long.select(entity, "signal", *[F.round(c, digits).alias(c) for c in ("mean", "std", "last_value")])


def _band_aggs(signals: Sequence[str]) -> list[Column]:
    aggs = []
    for s in signals:
        x = F.col(s).cast("double")
        aggs += [(F.avg(x) - F.stddev_samp(x)).alias(f"{s}_band_low"),
                 (F.avg(x) + F.stddev_samp(x)).alias(f"{s}_band_high")]
    return aggs


def _span_aggs(signals: Sequence[str]) -> list[Column]:
    return [agg(F.col(s).cast("double")).alias(f"_{s}_{name}") for s in signals
            for agg, name in ((F.min, "min"), (F.max, "max"))]


def personal_band(df: DataFrame, entity: str, signals: Sequence[str], stats_from: DataFrame | None = None) -> DataFrame:
    """Adds ``<sig>_band_low/high`` = mean -/+ sample std of the entity's full
    history (``stats_from``, default ``df``), also when ``df`` is a filtered view."""
    src = stats_from if stats_from is not None else df
    return df.join(src.groupBy(entity).agg(*_band_aggs(signals)), entity, "left")


def minmax_normalise(df: DataFrame, entity: str, signals: Sequence[str], stats_from: DataFrame | None = None,
                     suffix: str = "_norm") -> DataFrame:
    """``(x - min) / span`` by the entity's full-history min/max; a zero span
    divides by 1. Band columns ``<sig>_band_low/high``, when present, are
    normalised the same way."""
    src = stats_from if stats_from is not None else df
    return _normalise(df.join(src.groupBy(entity).agg(*_span_aggs(signals)), entity, "left"), signals, suffix)


def _normalise(d: DataFrame, signals: Sequence[str], suffix: str = "_norm") -> DataFrame:
    for s in signals:
        lo = F.col(f"_{s}_min")
        span = F.coalesce(F.nullif(F.col(f"_{s}_max") - lo, F.lit(0.0)), F.lit(1.0))
        d = d.withColumn(f"{s}{suffix}", (F.col(s) - lo) / span)
        for b in ("band_low", "band_high"):
            if f"{s}_{b}" in d.columns:
                d = d.withColumn(f"{s}_{b}{suffix}", (F.col(f"{s}_{b}") - lo) / span)
        d = d.drop(f"_{s}_min", f"_{s}_max")
    return d


def risk_band_limits(df: DataFrame, score: str = "risk_score", uncertainty: str = "uncertainty") -> DataFrame:
    """``upper = min(score + unc, 1)``, ``lower = max(score - unc, 0)``."""
    return (df.withColumn("upper", F.least(F.col(score) + F.col(uncertainty), F.lit(1.0)))
              .withColumn("lower", F.greatest(F.col(score) - F.col(uncertainty), F.lit(0.0))))


def alert_history(alerts: DataFrame, entity: str, entity_id=None, ts: str = "alert_time") -> DataFrame:
    """One entity's alerts, newest first; with ``entity_id=None`` every
    entity's history, ordered by entity and then newest first (a range-
    partitioned sort, no single task)."""
    if entity_id is None:
        return alerts.orderBy(F.col(entity).asc(), F.col(ts).desc())
    return alerts.filter(F.col(entity) == F.lit(entity_id)).orderBy(F.col(ts).desc())


def new_alerts(latest: DataFrame, entity: str, ts: str, threshold: float = RISK_HIGH,
               score: str = "risk_score", uncertainty: str = "uncertainty") -> DataFrame:
    """Alert rows ``(entity, alert_time, risk_score, uncertainty)`` for latest
    rows with ``score >= threshold`` (inclusive)."""
    return (latest.filter(F.col(score) >= threshold)
                  .select(entity, F.col(ts).alias("alert_time"), F.col(score).alias("risk_score"),
                          F.col(uncertainty).alias("uncertainty")))


def unlogged_alerts(new: DataFrame, existing: DataFrame, entity: str, ts: str = "alert_time") -> DataFrame:
    """Alerts not yet in the log (anti join on entity and alert time)."""
    return new.join(existing.select(entity, ts), [entity, ts], "left_anti")


def entity_summary(latest: DataFrame, entity: str, ts: str, vitals: Sequence[str] = (),
                   factors: Sequence[str] = (), score: str = "risk_score",
                   uncertainty: str = "uncertainty") -> DataFrame:
    """One text-ready row per entity: risk %, band, confidence %, vitals (whole
    numbers, halves to even) and the leading factors joined by ', ' (missing
    factors skipped)."""
    s, u = F.col(score), F.col(uncertainty)
    cols = [F.col(entity), F.col(ts).alias("last_update"),
            F.format_string("%.0f%%", F.bround(s * 100, 0)).alias("risk_pct"),
            risk_band_expr(score, RISK_MEDIUM, RISK_HIGH).alias("risk_band"),
            F.format_string("%.0f%%", F.bround((1 - u) * 100, 0)).alias("confidence_pct")]
    cols += [F.bround(F.col(v), 0).alias(f"{v}_shown") for v in vitals]
    if factors:
        cols.append(F.concat_ws(", ", *[F.col(f) for f in factors]).alias("main_factors"))
    return latest.select(*cols)


def trend_view(df: DataFrame, entity: str, ts: str, signals: Sequence[str], start=None, end=None,
               score: str = "risk_score", uncertainty: str = "uncertainty",
               threshold: float = RISK_HIGH) -> DataFrame:
    """Rows of the chosen date range (default: last 7 days per entity) with
    score, band limits, threshold, risk band, and each signal with its personal
    band, raw and min-max normalised; band statistics use the full history.
    Dates, bands and spans come from one aggregate, joined to the rows once."""
    from vitalgrid.operators.filters import in_date_range
    stats = df.groupBy(entity).agg(F.min(ts).alias("_t0"), F.max(ts).alias("_t1"), *_band_aggs(signals),
                                   *_span_aggs(signals))
    view = df.join(stats, entity, "inner").filter(in_date_range(ts, start, end)).drop("_t0", "_t1")
    view = _normalise(view, signals)
    view = risk_band_limits(view, score, uncertainty)
    return (view.withColumn("threshold", F.lit(threshold))
                .withColumn("risk_band", risk_band_expr(score, RISK_MEDIUM, RISK_HIGH)))


def reduction_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after a reduction and the cut in percent (2 places):
    both counts come from one aggregate over the tagged union, no join."""
    tagged = (before.select(F.lit(1).alias("_b"), F.lit(0).alias("_a"))
              .unionByName(after.select(F.lit(0).alias("_b"), F.lit(1).alias("_a"))))
    return (tagged.agg(F.sum("_b").cast("long").alias("rows_before"), F.sum("_a").cast("long").alias("rows_after"))
            .select(F.coalesce("rows_before", F.lit(0)).alias("rows_before"),
                    F.coalesce("rows_after", F.lit(0)).alias("rows_after"))
            .withColumn("reduction_percent",
                        F.round(100 * (1 - F.col("rows_after") / F.greatest(F.col("rows_before"), F.lit(1))), 2)))


def preview(df: DataFrame, order: Sequence[str], n: int = 10, digits: int = 3) -> DataFrame:
    """First ``n`` rows by ``order`` with doubles rounded (a top-n report)."""
    from vitalgrid.functions.scalar import round_doubles
    return round_doubles(df.orderBy(*order).limit(n), digits)


def serving_table(features: DataFrame, model, entity: str, ts: str, signals: Sequence[str],
                  cols: Sequence[str], days: float = 3, bin_size: str = "15 minutes",
                  explain_exclude: Sequence[str] = (), names: Mapping[str, str] | None = None,
                  k: int = 3, tie: Sequence[str] = ()) -> DataFrame:
    """The serving job: last ``days`` of every entity -> risk score and per-tree
    uncertainty -> top-``k`` leading signals (importance x |z|) -> ``bin_size``
    bins (means; factors from the latest row with them) with incomplete bins
    dropped. ``features`` must already hold trends computed on the full
    history (a filter before the rolling window would shorten it)."""
    from vitalgrid.operators.filters import recent_window
    from vitalgrid.operators.models import signal_importance, tree_uncertainty
    recent = recent_window(features, entity, ts, days)
    scored = tree_uncertainty(model, recent, cols)
    imp = signal_importance(model, cols, signals, exclude=explain_exclude)
    scored = top_k_factors(scored, {s: f"{s}_zscore" for s in imp}, imp, k=k, names=names)
    factors = [f"top_factor_{j + 1}" for j in range(min(k, len(imp)))]
    return downsample(scored.select(entity, ts, *tie, *signals, "risk_score", "uncertainty", *factors),
                      entity, ts, bin_size, [*signals, "risk_score", "uncertainty"], factors, tie=tie)
