"""Regular-grid repair: grid index, gaps, reindex, limited interpolation, flags.

A panel is meant to hold one row per entity and ``step``; the grid of an entity
runs from its first to its last timestamp (anchored at the first one).

Scale design: the full grid is never built by a join. Present on-grid rows get
their grid index ``k``; the next present index comes from a chunked carry
(``sequence.carry_last``); each present row then emits the points
``k .. k_next - 1`` with ``explode(sequence(...))``, long gaps by pieces of
``GAP_POINTS``. The only shuffles are the small bounds aggregate and the carry's
chunk partitioning.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.operators.sequence import carry_both, carry_last

K = "_k"
DEFAULT_CHUNK_POINTS = 250_000
#: Missing points of a long gap that one array holds.
GAP_POINTS = 100_000
_UNITS = {"microsecond": 1, "millisecond": 1000, "second": 1_000_000, "minute": 60_000_000,
          "hour": 3_600_000_000, "day": 86_400_000_000, "week": 7 * 86_400_000_000}


def step_micros(step: str | int) -> int:
    """'15 minutes' -> microseconds (ints pass through)."""
    if isinstance(step, int):
        return step
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", step.lower())
    if not m or m.group(2) not in _UNITS:
        raise ValueError(f"unsupported step {step!r}")
    return int(m.group(1)) * _UNITS[m.group(2)]


def _ts_at(t0, k, step_us: int):
    return F.timestamp_micros(F.unix_micros(t0) + k * F.lit(step_us))


def on_grid(df: DataFrame, entity: str, ts: str, step: str | int) -> DataFrame:
    """Keep rows that sit on the entity's grid and add ``_k`` (grid index),
    ``_t0`` (grid anchor = first timestamp of the entity) and ``_kend`` (index
    of the last grid point not after the entity's last timestamp). Off-grid
    rows are dropped, as a reindex drops them. The bounds table has one row per
    entity and is pre-aggregated map-side, so a hot entity costs one row."""
    us = step_micros(step)
    bounds = df.groupBy(entity).agg(F.min(ts).alias("_t0"), F.max(ts).alias("_t1"))
    d = df.join(bounds, entity, "inner")
    off = F.unix_micros(F.col(ts)) - F.unix_micros(F.col("_t0"))
    kend = F.floor((F.unix_micros(F.col("_t1")) - F.unix_micros(F.col("_t0"))) / us).cast("long")
    return (d.filter(off % us == 0).withColumn(K, (off / us).cast("long"))
             .withColumn("_kend", kend).drop("_t1"))


def _with_next(d: DataFrame, entity: str, chunk_points: int, on_duplicate: str) -> DataFrame:
    d = d.withColumn("_ck", F.floor(F.col(K) / chunk_points).cast("long")).withColumn("_kx", F.col(K))
    d = carry_last(d, entity, "_ck", [K], ["_kx"], suffix="_next", reverse=True, inclusive=False)
    # after the last on-grid row the grid still runs to ``_kend`` (last row off-grid)
    d = d.withColumn("_kx_next", F.coalesce(F.col("_kx_next"), F.col("_kend") + 1))
    if on_duplicate == "error":
        d = d.withColumn("_kx_next", F.when(F.col("_kx_next") == F.col(K), F.raise_error(
            F.concat(F.lit("duplicate timestamp on the grid of entity "), F.col(entity).cast("string"))))
            .otherwise(F.col("_kx_next")))
    return d


def _dedupe(d: DataFrame, entity: str, order: Sequence[str] | None) -> DataFrame:
    """Keep the last row per grid point by ``order`` (``on_duplicate='last'``)."""
    if not order:
        raise ValueError("on_duplicate='last' needs order: without it any of the rows could win")
    cols = [c for c in d.columns]
    okey = F.struct(*[F.col(o) for o in order])
    return (d.groupBy(entity, K).agg(F.max_by(F.struct(*[F.col(c) for c in cols]), okey).alias("_r"))
             .select("_r.*"))


def find_gaps(df: DataFrame, entity: str, ts: str, step: str | int = "1 minute", small_max_steps: int = 5,
              chunk_points: int = DEFAULT_CHUNK_POINTS) -> DataFrame:
    """Runs of missing grid points per entity: ``start, end`` (first and last
    missing point), ``duration_steps``, ``duration_minutes = end - start + one step``
    and ``is_large_gap = duration_steps > small_max_steps``."""
    us = step_micros(step)
    d = _with_next(on_grid(df.select(entity, ts), entity, ts, step), entity, chunk_points, "keep")
    g = d.filter(F.col("_kx_next") - F.col(K) > 1)
    start = _ts_at(F.col("_t0"), F.col(K) + 1, us)
    end = _ts_at(F.col("_t0"), F.col("_kx_next") - 1, us)
    steps = (F.col("_kx_next") - F.col(K) - 1).cast("long")
    return (g.select(entity, start.alias("start"), end.alias("end"), steps.alias("duration_steps"))
             .withColumn("duration_minutes", F.col("duration_steps").cast("double") * F.lit(us / 60_000_000.0))
             .withColumn("is_large_gap", F.col("duration_steps") > small_max_steps))


def gap_summary(gaps: DataFrame, entities: DataFrame, entity: str) -> DataFrame:
    """Per entity (also those without gaps): ``n_gaps, n_small, n_large``."""
    g = gaps.groupBy(entity).agg(F.count(F.lit(1)).alias("n_gaps"),
                                 F.count_if(~F.col("is_large_gap")).alias("n_small"),
                                 F.count_if(F.col("is_large_gap")).alias("n_large"))
    e = entities.select(entity).distinct()
    return (e.join(g, entity, "left")
             .select(entity, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                               for c in ("n_gaps", "n_small", "n_large")]))


def reindex_to_grid(df: DataFrame, entity: str, ts: str, step: str | int = "1 minute",
                    on_duplicate: str = "error", order: Sequence[str] | None = None,
                    chunk_points: int = DEFAULT_CHUNK_POINTS, keep_index: bool = False) -> DataFrame:
    """One row per grid point from the entity's first to last timestamp; missing
    points carry NULL in every other column; off-grid rows are dropped.
    ``on_duplicate``: 'error' (raise, as a pandas reindex does) or 'last'
    (keep the last row by ``order``, which must then be given). Adds ``was_present``."""
    us = step_micros(step)
    d = on_grid(df, entity, ts, step)
    if on_duplicate == "last":
        d = _dedupe(d, entity, order)
    d = _with_next(d, entity, chunk_points, on_duplicate)
    # each present row emits its own grid point and the missing ones up to the next present row
    last = F.greatest(F.col(K), F.col("_kx_next") - 1)
    d = d.withColumn("_from", F.explode(F.sequence(F.col(K), last, F.lit(GAP_POINTS).cast("long"))))
    d = d.withColumn("_at", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (GAP_POINTS - 1), last))))
    here = F.col("_at") == F.col(K)
    value = {entity: F.col(entity), ts: F.when(here, F.col(ts)).otherwise(_ts_at(F.col("_t0"), F.col("_at"), us))}
    return d.select(*[value.get(c, F.when(here, F.col(c))).alias(c) for c in df.columns], here.alias("was_present"),
                    *([F.col("_at").alias(K)] if keep_index else []))


def missing_grid_points(df: DataFrame, entity: str, ts: str, step: str | int = "1 minute",
                        chunk_points: int = DEFAULT_CHUNK_POINTS) -> DataFrame:
    """Grid points with no row (the set difference grid minus data): ``entity, ts``."""
    g = reindex_to_grid(df.select(entity, ts), entity, ts, step, on_duplicate="keep", chunk_points=chunk_points)
    return g.filter(~F.col("was_present")).select(entity, ts)


def interpolate_limited(grid: DataFrame, entity: str, ts: str, signals: Sequence[str], limit: int = 5,
                        mode: str = "prefix", step: str | int = "1 minute",
                        chunk_points: int = DEFAULT_CHUNK_POINTS) -> DataFrame:
    """Linear interpolation inside gaps only (both ends known), per signal.

    ``mode='prefix'`` fills the first ``limit`` points of every inner gap, long
    gaps too (pandas ``interpolate(limit=n, limit_area='inside')``);
    ``mode='small_only'`` fills only gaps of at most ``limit`` points.
    Needs ``grid`` from ``reindex_to_grid`` (regular, one row per point)."""
    if mode not in ("prefix", "small_only"):
        raise ValueError("mode must be 'prefix' or 'small_only'")
    us = step_micros(step)
    own_k = K not in grid.columns
    if own_k:
        bounds = grid.groupBy(entity).agg(F.min(ts).alias("_g0"))
        d = grid.join(bounds, entity, "inner")
        d = d.withColumn(K, ((F.unix_micros(F.col(ts)) - F.unix_micros(F.col("_g0"))) / us).cast("long"))
        d = d.drop("_g0")
    else:
        d = grid
    d = d.withColumn("_ck", F.floor(F.col(K) / chunk_points).cast("long"))
    # one carried column per signal: (position, value) of its non-NULL cells
    d = d.select("*", *[F.when(F.col(s).isNotNull(), F.struct(F.col(K).alias("k"), F.col(s).alias("v")))
                        .alias(f"_p_{s}") for s in signals])
    carried = [f"_p_{s}" for s in signals]
    d = carry_both(d, entity, "_ck", [K], carried)
    k = F.col(K)
    filled = {}
    for s in signals:
        bf, af = F.col(f"_p_{s}_bf"), F.col(f"_p_{s}_af")
        kp, kn, vp, vn = bf["k"], af["k"], bf["v"], af["v"]
        ok = F.col(s).isNull() & bf.isNotNull() & af.isNotNull()
        ok = ok & ((k - kp) <= limit if mode == "prefix" else (kn - kp - 1) <= limit)
        fill = (vn - vp) / (kn - kp).cast("double") * (k - kp).cast("double") + vp
        filled[s] = F.when(ok, fill).otherwise(F.col(s))
    d = d.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in d.columns])
    drop = [c for c in d.columns if c.startswith("_p_") or c.endswith(("_bf", "_af"))] + ["_ck"]
    return d.drop(*drop, *([K] if own_k else []))


def clean_panel(df: DataFrame, entity: str, ts: str, signals: Sequence[str], step: str | int = "1 minute",
                limit: int = 5, mode: str = "prefix", on_duplicate: str = "error",
                order: Sequence[str] | None = None, chunk_points: int = DEFAULT_CHUNK_POINTS,
                row_number: str | None = None) -> DataFrame:
    """Reindex to the grid, interpolate, flag: adds ``was_missing`` (first signal
    NULL before filling, also for a present row with a NULL reading) and
    ``device_not_worn`` (first signal still NULL after filling).
    ``row_number``: also keep the 1-based position of each row in its entity's
    series under that name (= grid index + 1 on a regular grid), so ordered
    operators downstream need no row numbering pass."""
    if mode not in ("prefix", "small_only"):
        raise ValueError("mode must be 'prefix' or 'small_only'")
    us = step_micros(step)
    keep = [entity, ts, *signals, *[o for o in (order or []) if o not in (entity, ts, *signals)]]
    d = on_grid(df.select(*keep), entity, ts, step)
    if on_duplicate == "last":
        d = _dedupe(d, entity, order)
    # every present row learns the next row and, per signal, the known readings around it: one carry over present rows
    d = d.withColumns({"_ck": F.floor(F.col(K) / chunk_points).cast("long"), "_kx": F.col(K), **{
        f"_p{i}": F.when(F.col(s).isNotNull(), F.struct(F.col(K).alias("k"), F.col(s).cast("double").alias("v")))
        for i, s in enumerate(signals)}})
    d = carry_both(d, entity, "_ck", [K], ["_kx", *[f"_p{i}" for i in range(len(signals))]], strictly_after=True)
    following = F.coalesce(F.col("_kx_af"), F.col("_kend") + 1)
    if on_duplicate == "error":
        following = F.when(following == F.col(K), F.raise_error(F.concat(
            F.lit("duplicate timestamp on the grid of entity "), F.col(entity).cast("string"))).cast("long")).otherwise(following)
    # and emits its own grid point and the missing ones up to the next row, filled on the spot
    last = F.greatest(F.col(K), following - 1)
    d = d.withColumn("_last", last).withColumn("_from", F.explode(F.sequence(
        F.col(K), F.col("_last"), F.lit(GAP_POINTS).cast("long"))))
    d = d.withColumn("_at", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (GAP_POINTS - 1), F.col("_last")))))
    at, here = F.col("_at"), F.col("_at") == F.col(K)

    def filled(i: int, signal: str) -> Column:
        before, after = F.col(f"_p{i}_bf"), F.col(f"_p{i}_af")
        near = (at - before["k"]) <= limit if mode == "prefix" else (after["k"] - before["k"] - 1) <= limit
        slope = (after["v"] - before["v"]) / (after["k"] - before["k"]).cast("double")
        line = slope * (at - before["k"]).cast("double") + before["v"]
        return F.when(here & F.col(signal).isNotNull(), F.col(signal)).when(after.isNotNull() & near, line)

    stamp = F.when(here, F.col(ts)).otherwise(_ts_at(F.col("_t0"), at, us))
    extra = [(at + 1).alias(row_number)] if row_number else []
    d = d.select(entity, stamp.alias(ts), *[filled(i, s).alias(s) for i, s in enumerate(signals)],
                 (~here | F.col(signals[0]).isNull()).alias("was_missing"), *extra)
    return flag_missing(d, signals[0], before=False).select(entity, ts, *signals, "was_missing", "device_not_worn",
                                                            *([row_number] if row_number else []))


def flag_missing(df: DataFrame, first_signal: str, before: bool) -> DataFrame:
    """``was_missing`` (before interpolation) or ``device_not_worn`` (after)."""
    name = "was_missing" if before else "device_not_worn"
    return df.withColumn(name, F.col(first_signal).isNull())


def fill_summary(clean: DataFrame) -> DataFrame:
    """Rows, interpolated rows (missing but filled) and not-worn rows."""
    return clean.agg(F.count(F.lit(1)).alias("n_rows"),
                     F.count_if(F.col("was_missing") & ~F.col("device_not_worn")).alias("n_interpolated"),
                     F.count_if(F.col("device_not_worn")).alias("n_not_worn"))
