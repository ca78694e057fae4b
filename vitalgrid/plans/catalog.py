"""The registered queries: each applies library operators to a fixture adapter
of the driver tables and has, where SQL can say it, a DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrid.operators import aggregates as A
from vitalgrid.operators import baselines as B
from vitalgrid.operators import sequence as S
from vitalgrid.plans.registry import query, rounded
from vitalgrid.sources import fixtures as X

E, T, ORD = "user_id", "ts", ["ts", "event_id"]
SIG = X.P_RAW_SIGNALS
ZC = [f"{s}_zscore" for s in SIG]

from vitalgrid.plans.common import STATS_SQL, Z_SQL, flag_sql  # noqa: E402,F401


def flagged_raw(spark, d, thr: float = 2.0):
    """P-raw -> personal z-scores -> one-row event flag."""
    r = X.p_raw(spark, d)
    z = B.zscore(r, E, SIG)
    return B.any_exceeds(z, ZC, thr)


# ------------------------------------------------------------------ step 1: minimum slice
@query("anomaly_share", flag_sql(2.0) + """
SELECT user_id, count(*) AS n_rows, sum(CAST(risk_event_now AS BIGINT)) AS n_events,
       round(avg(CAST(risk_event_now AS DOUBLE)), 6) AS event_share
FROM flagged GROUP BY user_id""")
def anomaly_share(spark, d):
    """Share of readings that are personal anomalies (|z| > 2 on any signal), per entity."""
    return rounded(A.event_rate(flagged_raw(spark, d), "risk_event_now", by=E))


@query("entity_stats", STATS_SQL + """
SELECT user_id, round(value_mean, 6) AS value_mean, round(value_std, 6) AS value_std,
       round(k_mean, 6) AS k_mean, round(k_std, 6) AS k_std FROM st""")
def q_entity_stats(spark, d):
    return rounded(B.entity_stats(X.p_raw(spark, d), E, SIG))


@query("attach_stats", STATS_SQL + """
SELECT p.user_id, p.event_id, p.value, round(st.value_mean, 6) AS value_mean,
       round(st.value_std, 6) AS value_std, round(st.k_mean, 6) AS k_mean, round(st.k_std, 6) AS k_std
FROM p_raw p LEFT JOIN st USING (user_id)""")
def q_attach_stats(spark, d):
    r = X.p_raw(spark, d)
    out = B.attach_stats(r, B.entity_stats(r, E, SIG), E)
    return rounded(out.select(E, "event_id", "value", "value_mean", "value_std", "k_mean", "k_std"))


@query("attach_group_agg", X.P_RAW_SQL + """
SELECT user_id, event_id,
       round(avg(value) OVER (PARTITION BY user_id), 6) AS value_mean,
       min(value) OVER (PARTITION BY user_id) AS value_min,
       max(k) OVER (PARTITION BY user_id) AS k_max,
       count(*) OVER (PARTITION BY user_id) AS n_rows
FROM p_raw""")
def q_attach_group_agg(spark, d):
    r = X.p_raw(spark, d)
    out = B.attach_group_agg(r, E, {"value_mean": F.avg("value"), "value_min": F.min("value"),
                                    "k_max": F.max("k"), "n_rows": F.count(F.lit(1))})
    return rounded(out.select(E, "event_id", "value_mean", "value_min", "k_max", "n_rows"))


@query("zscore", Z_SQL + """
SELECT user_id, event_id, round(value_zscore, 6) AS value_zscore, round(k_zscore, 6) AS k_zscore FROM z""")
def q_zscore(spark, d):
    return rounded(B.zscore(X.p_raw(spark, d), E, SIG).select(E, "event_id", *ZC))


@query("any_exceeds", flag_sql(2.0) + """
SELECT user_id, event_id, risk_event_now FROM flagged""")
def q_any_exceeds(spark, d):
    return flagged_raw(spark, d).select(E, "event_id", "risk_event_now")


@query("event_rate", flag_sql(2.0) + """
SELECT count(*) AS n_rows, sum(CAST(risk_event_now AS BIGINT)) AS n_events,
       round(avg(CAST(risk_event_now AS DOUBLE)), 6) AS event_share FROM flagged""")
def q_event_rate(spark, d):
    return rounded(A.event_rate(flagged_raw(spark, d), "risk_event_now"))


# ------------------------------------------------------------------ step 2: labels and trends
@query("rolling_mean", Z_SQL + """
SELECT user_id, event_id,
       round(avg(value_zscore) OVER w, 6) AS value_zscore_trend,
       round(avg(k_zscore) OVER w, 6) AS k_zscore_trend
FROM z WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def q_rolling_mean(spark, d):
    z = B.zscore(X.p_raw(spark, d), E, SIG)
    out = S.rolling_mean(z, E, ORD, ZC, rows=5)
    return rounded(out.select(E, "event_id", "value_zscore_trend", "k_zscore_trend"))


@query("future_event", flag_sql(2.0) + """
SELECT user_id, event_id, risk_event_now,
       CAST(coalesce(max(CAST(risk_event_now AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id
            ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), 0) AS INTEGER) AS target_future_risk
FROM flagged""")
def q_future_event(spark, d):
    out = S.future_event(flagged_raw(spark, d), E, ORD, "risk_event_now", horizon=6)
    return out.select(E, "event_id", "risk_event_now", "target_future_risk")


@query("sustained", flag_sql(1.0) + """
SELECT user_id, event_id, risk_event_now AS event_now,
       (count(*) OVER w = 2 AND min(CAST(risk_event_now AS INTEGER)) OVER w = 1) AS sustained_event
FROM flagged WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""")
def q_sustained(spark, d):
    out = S.sustained(flagged_raw(spark, d, 1.0), E, ORD, "risk_event_now", rows=2, out="sustained_event")
    return out.select(E, "event_id", F.col("risk_event_now").alias("event_now"), "sustained_event")


LABEL_SQL = flag_sql(1.0) + """,
sus AS (SELECT *, (count(*) OVER w = 2 AND min(CAST(risk_event_now AS INTEGER)) OVER w = 1) AS sustained_event
        FROM flagged WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
lab AS (SELECT *, CAST(coalesce(max(CAST(sustained_event AS INTEGER)) OVER (PARTITION BY user_id
            ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), 0) AS INTEGER) AS target_future_risk
        FROM sus)"""


def labelled_raw(spark, d):
    """Sustained-event label pipeline: z -> |z|>1 -> sustained(2) -> future(6)."""
    f = flagged_raw(spark, d, 1.0)
    f = S.row_index(f, E, ORD)
    f = S.sustained(f, E, ORD, "risk_event_now", rows=2, out="sustained_event", rn=S.RN)
    return S.future_event(f, E, ORD, "sustained_event", horizon=6, rn=S.RN).drop(S.RN)


@query("label_rate", LABEL_SQL + """
SELECT count(*) AS n_rows, sum(CAST(target_future_risk AS BIGINT)) AS n_positive,
       round(avg(CAST(target_future_risk AS DOUBLE)), 6) AS positive_share FROM lab""")
def q_label_rate(spark, d):
    return rounded(A.label_rate(labelled_raw(spark, d)))


@query("flag_episodes", flag_sql(1.0) + """,
f AS (SELECT user_id, ts FROM flagged WHERE risk_event_now),
g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
              OR ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new_ep
      FROM f),
e AS (SELECT user_id, ts, sum(new_ep) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS ep FROM g)
SELECT user_id, min(ts) AS episode_start, max(ts) AS episode_end, count(*) AS n_rows FROM e GROUP BY user_id, ep""")
def q_flag_episodes(spark, d):
    return S.flag_episodes(flagged_raw(spark, d, 1.0), E, T, "risk_event_now", max_gap="12 hours")


# further query groups register themselves on import
from vitalgrid.plans import q_clean  # noqa: E402,F401
from vitalgrid.plans import q_serving, q_eval  # noqa: E402,F401
from vitalgrid.plans import q_models  # noqa: E402,F401
from vitalgrid.plans import q_grouped  # noqa: E402,F401
from vitalgrid.plans import q_io  # noqa: E402,F401
