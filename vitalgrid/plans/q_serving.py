"""Filters, serving-side operators and their oracles.

Inputs: P-raw (events as a panel), P-type (per user and day, one signal per
event type), P-serve (P-raw with a score and an uncertainty in [0, 1)) and
Q-form (customer rows as questionnaire text)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrid.operators import aggregates as A
from vitalgrid.operators import baselines as B
from vitalgrid.operators import filters as FL
from vitalgrid.operators import serving as V
from vitalgrid.operators import splits as SP
from vitalgrid.plans.registry import query, rounded
from vitalgrid.sources import fixtures as X

E, T = "user_id", "ts"
R = "received_date"
TYPES = X.EVENT_TYPES

# Fixed values used by the queries below (parameters of the fixture, not data).
TYPE_NAMES = {"click": "Click", "error": "Error", "purchase": "Purchase", "signup": "Signup", "view": "View"}
TYPE_WEIGHTS = {"click": 0.3, "error": 0.25, "purchase": 0.2, "signup": 0.15, "view": 0.1}
ALERT_LOG_CUTOFF = "2024-01-15"


# ------------------------------------------------------------------ filters
@query("keep_entities", X.P_RAW_SQL + """
SELECT user_id, event_id FROM p_raw
WHERE user_id IN (SELECT user_id FROM p_raw WHERE event_type = 'purchase' AND value > 90)""")
def q_keep_entities(spark, d):
    r = X.p_raw(spark, d)
    ids = r.filter((F.col("event_type") == "purchase") & (F.col("value") > 90)).select(E)
    return FL.keep_entities(r, E, ids).select(E, "event_id")


@query("first_n_entities", X.P_RAW_SQL + """
SELECT user_id, event_id FROM p_raw
WHERE user_id IN (SELECT DISTINCT user_id FROM p_raw ORDER BY user_id LIMIT 10)""")
def q_first_n_entities(spark, d):
    return FL.first_n_entities(X.p_raw(spark, d), E, 10).select(E, "event_id")


@query("recent_window", X.P_RAW_SQL + """
SELECT p.user_id, p.event_id, p.ts FROM p_raw p
JOIN (SELECT user_id, max(ts) AS tmax FROM p_raw GROUP BY user_id) m USING (user_id)
WHERE p.ts >= m.tmax - INTERVAL 3 DAY""")
def q_recent_window(spark, d):
    return FL.recent_window(X.p_raw(spark, d), E, T, days=3).select(E, "event_id", T)


DATE_RANGE_SQL = """dr AS (
  SELECT p.* FROM p_serve p
  JOIN (SELECT user_id, min(received_date) AS t0, max(received_date) AS t1 FROM p_serve GROUP BY user_id) b
    USING (user_id)
  WHERE CAST(p.received_date AS DATE) BETWEEN CAST(greatest(b.t0, b.t1 - INTERVAL 7 DAY) AS DATE)
                                          AND CAST(b.t1 AS DATE))"""


@query("date_range", X.P_SERVE_SQL + ",\n" + DATE_RANGE_SQL + """
SELECT user_id, event_id, received_date FROM dr""")
def q_date_range(spark, d):
    return FL.date_range(X.p_serve(spark, d), E, R).select(E, "event_id", R)


@query("drop_incomplete", X.P_TYPE_SQL + """
SELECT user_id, ts FROM p_type
WHERE click IS NOT NULL AND error IS NOT NULL AND purchase IS NOT NULL""")
def q_drop_incomplete(spark, d):
    return FL.drop_incomplete(X.p_type(spark, d), ["click", "error", "purchase"]).select(E, T)


@query("coerce_numeric", X.Q_FORM_SQL + """
SELECT resp_id, TRY_CAST(lik_1 AS DOUBLE) AS lik_1, TRY_CAST(lik_2 AS DOUBLE) AS lik_2,
       TRY_CAST(lik_3 AS DOUBLE) AS lik_3 FROM q_form""")
def q_coerce_numeric(spark, d):
    return FL.coerce_numeric(X.q_form(spark, d), X.Q_LIKERT).select("resp_id", *X.Q_LIKERT)


@query("row_sum", X.Q_FORM_SQL + """
SELECT resp_id, coalesce(TRY_CAST(lik_1 AS DOUBLE), 0) + coalesce(TRY_CAST(lik_2 AS DOUBLE), 0)
       + coalesce(TRY_CAST(lik_3 AS DOUBLE), 0) AS total FROM q_form""")
def q_row_sum(spark, d):
    f = FL.coerce_numeric(X.q_form(spark, d), X.Q_LIKERT)
    return FL.row_sum(f, X.Q_LIKERT, "total").select("resp_id", "total")


@query("risk_band", X.P_SERVE_SQL + """
SELECT user_id, event_id, CASE WHEN risk_score >= 0.7 THEN 'High' WHEN risk_score >= 0.4 THEN 'Medium'
       WHEN risk_score IS NOT NULL THEN 'Low' END AS risk_band FROM p_serve""")
def q_risk_band(spark, d):
    return FL.risk_band(X.p_serve(spark, d)).select(E, "event_id", "risk_band")


@query("relabel", X.P_RAW_SQL + """
SELECT event_id, CASE event_type """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_NAMES.items())
       + """ END AS event_name FROM p_raw""")
def q_relabel(spark, d):
    return FL.relabel(X.p_raw(spark, d), "event_type", TYPE_NAMES, out="event_name").select("event_id", "event_name")


@query("narrow_types", X.P_SHIP_SQL + """
SELECT CAST(supp AS SMALLINT) AS supp, ts, l_orderkey, l_linenumber, CAST(qty AS FLOAT) AS qty,
       CAST(price AS FLOAT) AS price FROM p_ship""")
def q_narrow_types(spark, d):
    """Sink-side narrowing: float32 signals, int16 entity."""
    p = X.p_ship(spark, d)
    return FL.narrow_types(p, float_cols=["qty", "price"], short_cols=["supp"])


# ------------------------------------------------------------------ aggregates over panels
@query("signal_card", X.P_RAW_SQL + """
SELECT user_id, 'value' AS signal, round(avg(value), 2) AS mean, round(stddev_samp(value), 2) AS std,
       round(arg_max(value, (ts, event_id)), 2) AS last_value FROM p_raw GROUP BY user_id
UNION ALL
SELECT user_id, 'k', round(avg(k), 2), round(stddev_samp(k), 2), round(arg_max(k, (ts, event_id)), 2)
FROM p_raw GROUP BY user_id""")
def q_signal_card(spark, d):
    return V.signal_card(X.p_raw(spark, d), E, T, X.P_RAW_SIGNALS, tie=["event_id"])


@query("bin_series", X.P_RAW_SQL + """
SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS ts, round(avg(value), 6) AS value, round(avg(k), 6) AS k
FROM p_raw GROUP BY 1, 2""")
def q_bin_series(spark, d):
    return rounded(V.bin_series(X.p_raw(spark, d), E, T, X.P_RAW_SIGNALS, "6 hours"))


DOWNSAMPLE_SQL = """ds AS (
  SELECT user_id, date_trunc('day', received_date) AS received_date, avg(value) AS value, avg(k) AS k,
         avg(risk_score) AS risk_score, avg(uncertainty) AS uncertainty,
         arg_max(event_type, (received_date, event_id)) FILTER (WHERE event_type IS NOT NULL) AS event_type
  FROM p_serve GROUP BY 1, 2)"""


@query("downsample", X.P_SERVE_SQL.replace("SELECT user_id, ts AS received_date,",
                                           "SELECT user_id, ts AS received_date, event_type,")
       + ",\n" + DOWNSAMPLE_SQL + """
SELECT user_id, received_date, round(value, 6) AS value, round(k, 6) AS k, round(risk_score, 6) AS risk_score,
       round(uncertainty, 6) AS uncertainty, event_type FROM ds
WHERE value IS NOT NULL AND k IS NOT NULL AND risk_score IS NOT NULL AND uncertainty IS NOT NULL
  AND event_type IS NOT NULL""")
def q_downsample(spark, d):
    s = X.p_serve(spark, d, with_type=True)
    out = V.downsample(s, E, R, "1 day", ["value", "k", "risk_score", "uncertainty"], ["event_type"],
                       tie=["event_id"])
    return rounded(out)


@query("reduction_report", X.P_SERVE_SQL + """
SELECT (SELECT count(*) FROM p_serve) AS rows_before,
       (SELECT count(*) FROM (SELECT DISTINCT user_id, date_trunc('day', received_date) FROM p_serve)) AS rows_after,
       round(100 * (1 - (SELECT count(*) FROM (SELECT DISTINCT user_id, date_trunc('day', received_date)
                                              FROM p_serve)) / greatest((SELECT count(*) FROM p_serve), 1)), 2)
         AS reduction_percent""")
def q_reduction_report(spark, d):
    s = X.p_serve(spark, d)
    ds = V.downsample(s, E, R, "1 day", ["value", "k", "risk_score", "uncertainty"])
    return V.reduction_report(s, ds)


# ------------------------------------------------------------------ latest row, alerts, summaries
TYPE_Z_SQL = X.P_TYPE_SQL + """,
tst AS (SELECT user_id, """ + ", ".join(
    f"avg({t}) AS {t}_m, stddev_samp({t}) AS {t}_s" for t in TYPES) + """ FROM p_type GROUP BY user_id),
tz AS (SELECT p.user_id, p.ts, """ + ", ".join(
    f"(p.{t} - tst.{t}_m) / nullif(tst.{t}_s, 0) AS {t}_zscore" for t in TYPES) + """
       FROM p_type p LEFT JOIN tst USING (user_id))"""


@query("latest_row", X.P_TYPE_SQL + """
SELECT user_id, ts, round(click, 6) AS click, round(error, 6) AS error FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id
           ORDER BY (click IS NOT NULL AND error IS NOT NULL) DESC, ts DESC) AS rn
  FROM p_type) WHERE rn = 1 AND click IS NOT NULL AND error IS NOT NULL""")
def q_latest_row(spark, d):
    out = V.latest_row(X.p_type(spark, d), E, T, required=["click", "error"])
    return rounded(out.select(E, T, "click", "error"))


@query("top_k_factors", TYPE_Z_SQL + """,
lf AS (""" + "\n  UNION ALL ".join(
    f"SELECT user_id, ts, {i} AS idx, '{TYPE_NAMES[t]}' AS name, "
    f"coalesce(-{TYPE_WEIGHTS[t]} * abs({t}_zscore), 1.0) AS key FROM tz" for i, t in enumerate(TYPES)) + """),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY key, idx) AS r FROM lf)
SELECT user_id, ts, max(CASE WHEN r = 1 THEN name END) AS top_factor_1,
       max(CASE WHEN r = 2 THEN name END) AS top_factor_2, max(CASE WHEN r = 3 THEN name END) AS top_factor_3
FROM rk GROUP BY user_id, ts""")
def q_top_k_factors(spark, d):
    z = B.zscore(X.p_type(spark, d), E, TYPES)
    out = V.top_k_factors(z, {t: f"{t}_zscore" for t in TYPES}, TYPE_WEIGHTS, k=3, names=TYPE_NAMES)
    return out.select(E, T, "top_factor_1", "top_factor_2", "top_factor_3")


LATEST_SERVE_SQL = X.P_SERVE_SQL + """,
lat AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY received_date DESC, event_id DESC) AS rn
  FROM p_serve) WHERE rn = 1)"""


def latest_serve(spark, d):
    return V.latest_row(X.p_serve(spark, d), E, R, required=["risk_score", "uncertainty"], tie=["event_id"])


@query("new_alerts", LATEST_SERVE_SQL + """
SELECT user_id, received_date AS alert_time, round(risk_score, 6) AS risk_score,
       round(uncertainty, 6) AS uncertainty FROM lat WHERE risk_score >= 0.7""")
def q_new_alerts(spark, d):
    return rounded(V.new_alerts(latest_serve(spark, d), E, R))


DAY_ALERTS_SQL = X.P_SERVE_SQL + """,
dl AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', received_date)
                               ORDER BY received_date DESC, event_id DESC) AS rn FROM p_serve) WHERE rn = 1),
al AS (SELECT user_id, received_date AS alert_time, risk_score, uncertainty FROM dl WHERE risk_score >= 0.7)"""


def day_alerts(spark, d, before=None):
    """Alert log as the dashboard would write it when opened once per day:
    the latest row of each entity and day, if its risk is high."""
    s = X.p_serve(spark, d).withColumn("_day", F.date_trunc("day", R))
    if before is not None:
        s = s.filter(F.col(R) < F.lit(before).cast("timestamp"))
    lat = V.latest_row(s, [E, "_day"], R, tie=["event_id"])
    return V.new_alerts(lat, E, R)


@query("unlogged_alerts", DAY_ALERTS_SQL + """,
old AS (SELECT * FROM al WHERE alert_time < TIMESTAMP '""" + ALERT_LOG_CUTOFF + """')
SELECT user_id, alert_time, round(risk_score, 6) AS risk_score, round(uncertainty, 6) AS uncertainty
FROM al WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.user_id = al.user_id AND old.alert_time = al.alert_time)""")
def q_unlogged_alerts(spark, d):
    new = day_alerts(spark, d)
    existing = new.filter(F.col("alert_time") < F.lit(ALERT_LOG_CUTOFF).cast("timestamp"))
    return rounded(V.unlogged_alerts(new, existing, E))


@query("alert_history", DAY_ALERTS_SQL + """
SELECT user_id, alert_time, round(risk_score, 6) AS risk_score, round(uncertainty, 6) AS uncertainty
FROM al ORDER BY user_id, alert_time DESC""")
def q_alert_history(spark, d):
    """Every entity's alert history, newest first within each entity."""
    return rounded(V.alert_history(day_alerts(spark, d), E))


@query("entity_summary", LATEST_SERVE_SQL + """
SELECT user_id, received_date AS last_update, printf('%.0f%%', round_even(risk_score * 100, 0)) AS risk_pct,
       CASE WHEN risk_score >= 0.7 THEN 'High' WHEN risk_score >= 0.4 THEN 'Medium' ELSE 'Low' END AS risk_band,
       printf('%.0f%%', round_even((1 - uncertainty) * 100, 0)) AS confidence_pct,
       round_even(value, 0) AS value_shown, round_even(k, 0) AS k_shown FROM lat""")
def q_entity_summary(spark, d):
    return V.entity_summary(latest_serve(spark, d), E, R, vitals=["value", "k"])


@query("risk_band_limits", X.P_SERVE_SQL + """
SELECT user_id, event_id, round(least(risk_score + uncertainty, 1.0), 6) AS upper,
       round(greatest(risk_score - uncertainty, 0.0), 6) AS lower FROM p_serve""")
def q_risk_band_limits(spark, d):
    return rounded(V.risk_band_limits(X.p_serve(spark, d)).select(E, "event_id", "upper", "lower"))


@query("personal_band", X.P_SERVE_SQL + ",\n" + DATE_RANGE_SQL + """,
bs AS (SELECT user_id, avg(value) - stddev_samp(value) AS lo, avg(value) + stddev_samp(value) AS hi
       FROM p_serve GROUP BY user_id)
SELECT dr.user_id, dr.event_id, round(bs.lo, 6) AS value_band_low, round(bs.hi, 6) AS value_band_high
FROM dr LEFT JOIN bs USING (user_id)""")
def q_personal_band(spark, d):
    s = X.p_serve(spark, d)
    view = FL.date_range(s, E, R)
    return rounded(V.personal_band(view, E, ["value"], stats_from=s)
                   .select(E, "event_id", "value_band_low", "value_band_high"))


@query("minmax_normalise", X.P_SERVE_SQL + """,
mm AS (SELECT user_id, min(value) AS lo, max(value) AS hi, min(k) AS klo, max(k) AS khi
       FROM p_serve GROUP BY user_id)
SELECT p.user_id, p.event_id, round((p.value - lo) / coalesce(nullif(hi - lo, 0), 1), 6) AS value_norm,
       round((p.k - klo) / coalesce(nullif(khi - klo, 0), 1), 6) AS k_norm
FROM p_serve p LEFT JOIN mm USING (user_id)""")
def q_minmax_normalise(spark, d):
    out = V.minmax_normalise(X.p_serve(spark, d), E, ["value", "k"])
    return rounded(out.select(E, "event_id", "value_norm", "k_norm"))


@query("trend_view", X.P_SERVE_SQL + ",\n" + DATE_RANGE_SQL + """,
st AS (SELECT user_id, avg(value) - stddev_samp(value) AS lo_b, avg(value) + stddev_samp(value) AS hi_b,
              min(value) AS mn, max(value) AS mx FROM p_serve GROUP BY user_id)
SELECT dr.user_id, dr.event_id, dr.received_date, round(risk_score, 6) AS risk_score,
       round(least(risk_score + uncertainty, 1.0), 6) AS upper, round(greatest(risk_score - uncertainty, 0.0), 6) AS lower,
       0.7 AS threshold,
       CASE WHEN risk_score >= 0.7 THEN 'High' WHEN risk_score >= 0.4 THEN 'Medium' ELSE 'Low' END AS risk_band,
       round(value, 6) AS value, round((value - mn) / coalesce(nullif(mx - mn, 0), 1), 6) AS value_norm,
       round((lo_b - mn) / coalesce(nullif(mx - mn, 0), 1), 6) AS value_band_low_norm,
       round((hi_b - mn) / coalesce(nullif(mx - mn, 0), 1), 6) AS value_band_high_norm
FROM dr LEFT JOIN st USING (user_id)""")
def q_trend_view(spark, d):
    out = V.trend_view(X.p_serve(spark, d), E, R, ["value"])
    return rounded(out.select(E, "event_id", R, "risk_score", "upper", "lower", "threshold", "risk_band",
                              "value", "value_norm", "value_band_low_norm", "value_band_high_norm"))


@query("preview", X.P_SERVE_SQL + """
SELECT user_id, event_id, received_date, round(risk_score, 3) AS risk_score, round(uncertainty, 3) AS uncertainty
FROM p_serve ORDER BY user_id, received_date, event_id LIMIT 10""")
def q_preview(spark, d):
    s = X.p_serve(spark, d).select(E, "event_id", R, "risk_score", "uncertainty")
    return V.preview(s, [E, R, "event_id"], n=10, digits=3)


# ------------------------------------------------------------------ samples
@query("sample_n", X.P_RAW_SQL + """
SELECT event_id, user_id FROM p_raw ORDER BY md5(CAST(event_id AS VARCHAR) || ':7'), event_id LIMIT 100""")
def q_sample_n(spark, d):
    return SP.sample_n(X.p_raw(spark, d), "event_id", 100, seed=7).select("event_id", E)


@query("sample_n_per_group", X.P_RAW_SQL + """
SELECT event_id, user_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5(CAST(event_id AS VARCHAR) || ':7'), event_id) AS r
  FROM p_raw) WHERE r <= 3""")
def q_sample_n_per_group(spark, d):
    return SP.sample_n(X.p_raw(spark, d), "event_id", 3, seed=7, by=E).select("event_id", E)


@query("value_counts_label", X.Y_EVENT_SQL + """
SELECT label, count(*) AS n FROM y_event GROUP BY label""")
def q_value_counts_label(spark, d):
    return A.value_counts(X.y_event(spark, d), "label")
