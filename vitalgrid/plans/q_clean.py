"""Cleaning queries (grid, gaps, interpolation, flags) on the P-day adapter:
one row per user and calendar day, step 1 day, interpolation limit 1."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrid.operators import aggregates as A
from vitalgrid.operators import grid as G
from vitalgrid.plans.registry import query, rounded
from vitalgrid.sources import fixtures as X

E, T = "user_id", "ts"
SIG = X.P_RAW_SIGNALS
STEP = "1 day"
LIMIT = 1

GRID_SQL = X.P_DAY_SQL + """,
b AS (SELECT user_id, min(ts) AS t0, max(ts) AS t1 FROM p_day GROUP BY user_id),
grid AS (SELECT user_id, unnest(generate_series(t0, t1, INTERVAL 1 DAY)) AS ts FROM b),
rg AS (SELECT g.user_id, g.ts, p.value, p.k, p.user_id IS NOT NULL AS was_present
       FROM grid g LEFT JOIN p_day p ON g.user_id = p.user_id AND g.ts = p.ts),
miss AS (SELECT user_id, ts FROM rg WHERE NOT was_present),
isl AS (SELECT user_id, ts, ts - to_days(CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) AS INTEGER)) AS grp
        FROM miss),
gaps AS (SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS duration_steps,
                count(*) * 1440.0 AS duration_minutes, count(*) > 1 AS is_large_gap
         FROM isl GROUP BY user_id, grp)"""

INTERP_SQL = GRID_SQL + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS kk FROM rg),
c AS (SELECT *,
        last_value(CASE WHEN value IS NOT NULL THEN kk END IGNORE NULLS) OVER wb AS kp_v,
        last_value(value IGNORE NULLS) OVER wb AS vp_v,
        first_value(CASE WHEN value IS NOT NULL THEN kk END IGNORE NULLS) OVER wa AS kn_v,
        first_value(value IGNORE NULLS) OVER wa AS vn_v,
        last_value(CASE WHEN k IS NOT NULL THEN kk END IGNORE NULLS) OVER wb AS kp_k,
        last_value(k IGNORE NULLS) OVER wb AS vp_k,
        first_value(CASE WHEN k IS NOT NULL THEN kk END IGNORE NULLS) OVER wa AS kn_k,
        first_value(k IGNORE NULLS) OVER wa AS vn_k
      FROM rk
      WINDOW wb AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             wa AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT user_id, ts, was_present, value IS NULL AS was_missing,
        CASE WHEN value IS NULL AND kp_v IS NOT NULL AND kn_v IS NOT NULL AND kk - kp_v <= 1
             THEN (vn_v - vp_v) / (kn_v - kp_v) * (kk - kp_v) + vp_v ELSE value END AS value,
        CASE WHEN k IS NULL AND kp_k IS NOT NULL AND kn_k IS NOT NULL AND kk - kp_k <= 1
             THEN (vn_k - vp_k) / (kn_k - kp_k) * (kk - kp_k) + vp_k ELSE k END AS k
      FROM c),
clean AS (SELECT user_id, ts, value, k, was_missing, value IS NULL AS device_not_worn FROM filled)"""


def day_panel(spark, d):
    return X.p_day(spark, d)


@query("reindex_to_grid", GRID_SQL + """
SELECT user_id, ts, round(value, 6) AS value, round(k, 6) AS k, was_present FROM rg""")
def q_reindex_to_grid(spark, d):
    g = G.reindex_to_grid(day_panel(spark, d), E, T, STEP)
    return rounded(g.select(E, T, "value", "k", "was_present"))


@query("missing_grid_points", GRID_SQL + """
SELECT user_id, ts FROM miss""")
def q_missing_grid_points(spark, d):
    return G.missing_grid_points(day_panel(spark, d), E, T, STEP)


@query("find_gaps", GRID_SQL + """
SELECT * FROM gaps""")
def q_find_gaps(spark, d):
    return G.find_gaps(day_panel(spark, d), E, T, STEP, small_max_steps=LIMIT)


@query("gap_summary", GRID_SQL + """
SELECT b.user_id, count(g.user_id) AS n_gaps,
       count(CASE WHEN NOT g.is_large_gap THEN 1 END) AS n_small,
       count(CASE WHEN g.is_large_gap THEN 1 END) AS n_large
FROM b LEFT JOIN gaps g ON b.user_id = g.user_id GROUP BY b.user_id""")
def q_gap_summary(spark, d):
    p = day_panel(spark, d)
    return G.gap_summary(G.find_gaps(p, E, T, STEP, small_max_steps=LIMIT), p, E)


@query("interpolate_limited", INTERP_SQL + """
SELECT user_id, ts, round(value, 6) AS value, round(k, 6) AS k FROM filled""")
def q_interpolate_limited(spark, d):
    g = G.reindex_to_grid(day_panel(spark, d), E, T, STEP)
    out = G.interpolate_limited(g, E, T, SIG, limit=LIMIT, step=STEP)
    return rounded(out.select(E, T, "value", "k"))


@query("flag_missing", INTERP_SQL + """
SELECT user_id, ts, was_missing, device_not_worn FROM clean""")
def q_flag_missing(spark, d):
    return G.clean_panel(day_panel(spark, d), E, T, SIG, STEP, limit=LIMIT).select(
        E, T, "was_missing", "device_not_worn")


@query("clean_panel", INTERP_SQL + """
SELECT user_id, ts, round(value, 6) AS value, round(k, 6) AS k, was_missing, device_not_worn FROM clean""")
def q_clean_panel(spark, d):
    return rounded(G.clean_panel(day_panel(spark, d), E, T, SIG, STEP, limit=LIMIT))


@query("fill_summary", INTERP_SQL + """
SELECT count(*) AS n_rows, count(CASE WHEN was_missing AND NOT device_not_worn THEN 1 END) AS n_interpolated,
       count(CASE WHEN device_not_worn THEN 1 END) AS n_not_worn FROM clean""")
def q_fill_summary(spark, d):
    return G.fill_summary(G.clean_panel(day_panel(spark, d), E, T, SIG, STEP, limit=LIMIT))


@query("clean_entity_stats", INTERP_SQL + """
SELECT user_id, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std,
       round(avg(k), 6) AS k_mean, round(stddev_samp(k), 6) AS k_std FROM clean GROUP BY user_id""")
def q_clean_entity_stats(spark, d):
    """Per-entity mean and sample std of the cleaned panel (the inter-entity bias check)."""
    from vitalgrid.operators.baselines import entity_stats
    return rounded(entity_stats(G.clean_panel(day_panel(spark, d), E, T, SIG, STEP, limit=LIMIT), E, SIG))


@query("profile", X.P_RAW_SQL + """
SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_entities, min(ts) AS first_ts, max(ts) AS last_ts
FROM p_raw""")
def q_profile(spark, d):
    return A.profile(X.p_raw(spark, d), E, T)


@query("entity_ids", X.P_RAW_SQL + """
SELECT DISTINCT user_id FROM p_raw""")
def q_entity_ids(spark, d):
    return A.entity_ids(X.p_raw(spark, d), E)


@query("null_counts", X.P_TYPE_SQL + """
SELECT * FROM (
""" + "\n  UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null FROM p_type"
    for c in ["user_id", "ts", *X.EVENT_TYPES]) + ")")
def q_null_counts(spark, d):
    return A.null_counts(X.p_type(spark, d))


@query("value_counts", X.P_RAW_SQL + """
SELECT event_type, count(*) AS n FROM p_raw GROUP BY event_type""")
def q_value_counts(spark, d):
    return A.value_counts(X.p_raw(spark, d), "event_type")
