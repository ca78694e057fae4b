"""Sources, sinks, gates and the alert stream, on the driver tables.

Files go to fresh folders under ``spark.checkpoint.dir`` (the shared folder
of the cluster)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.operators import serving as V
from vitalgrid.plans import q_eval  # noqa: F401  (registers model_table)
from vitalgrid.plans.registry import REGISTRY, query, rounded
from vitalgrid.session import checkpoint_dir
from vitalgrid.sources import fixtures as X
from vitalgrid.sources import io as IO

E, R = "user_id", "received_date"
SERVE_SCHEMA = T.StructType([T.StructField(E, T.LongType()), T.StructField(R, T.TimestampType()),
                             T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType()),
                             T.StructField("k", T.DoubleType()), T.StructField("risk_score", T.DoubleType()),
                             T.StructField("uncertainty", T.DoubleType())])
CUTOFF = "2024-01-15"


def scratch(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "io", f"{name}-{uuid.uuid4().hex}")


@query("read_panel", X.P_RAW_SQL + """
SELECT user_id, date_trunc('second', ts) AS received_date, round(value, 6) AS value, round(k, 6) AS k
FROM p_raw""")
def q_read_panel(spark, d):
    """P-raw written as CSV with day-first, whole-second timestamps, read back with an explicit schema."""
    path = scratch(spark, "panel-csv")
    p = X.p_raw(spark, d).select(E, F.col("ts").alias(R), "value", "k")
    (p.write.option("header", True).option("timestampFormat", IO.TS_DAY_FIRST).csv(path))
    back = IO.read_panel(spark, path, "csv", IO.TS_DAY_FIRST, IO.panel_schema(E, R, ["value", "k"]))
    return rounded(back)


@query("read_columns", X.P_RAW_SQL + """
SELECT user_id, round(k, 6) AS k FROM p_raw""")
def q_read_columns(spark, d):
    """Column projection at the scan (Parquet reads only the kept columns)."""
    path = scratch(spark, "panel-parquet")
    X.p_raw(spark, d).select(E, F.col("ts").alias(R), "value", "k").write.parquet(path)
    return rounded(IO.read_panel(spark, path, "parquet", schema=IO.panel_schema(E, R, ["value", "k"]),
                                 columns=[E, "k"]))


@query("write_panel", X.P_RAW_SQL + """
SELECT user_id, ts, event_id FROM p_raw""")
def q_write_panel(spark, d):
    """Range-clustered Parquet write of P-raw and the read-back rows."""
    path = scratch(spark, "written-panel")
    IO.write_panel(X.p_raw(spark, d).select(E, "ts", "event_id"), path, E, "ts")
    return spark.read.parquet(path)


@query("drop_leading_rows", X.Q_FORM_SQL + """
SELECT resp_id FROM q_form WHERE resp_id NOT IN (SELECT resp_id FROM q_form ORDER BY resp_id LIMIT 2)""")
def q_drop_leading_rows(spark, d):
    return IO.drop_leading_rows(X.q_form(spark, d), "resp_id", 2).select("resp_id")


@query("require_complete", X.P_RAW_SQL + """
SELECT count(DISTINCT user_id) AS n_entities, count(*) AS n_rows, true AS complete FROM p_raw""")
def q_require_complete(spark, d):
    return IO.require_complete(X.p_raw(spark, d), [E, "ts", "value", "k"], E, min_entities=1, min_rows=1)


@query("write_report", REGISTRY["model_table"][1])
def q_write_report(spark, d):
    """The model comparison table of the metric queries written as CSV and
    nested JSON, read back from JSON."""
    from vitalgrid.plans.q_eval import long_predictions
    from vitalgrid.operators.metrics import model_table
    t = model_table(long_predictions(spark, d), "model", "score", "label")
    path = scratch(spark, "report")
    IO.write_report(t, path, "models", nested={"metrics": ["auroc", "prauc"]})
    return rounded(spark.read.json(os.path.join(path, "models_json")).select("model", "metrics.auroc", "metrics.prauc"))


@query("append_alerts", X.P_SERVE_SQL + """,
dl AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', received_date)
                               ORDER BY received_date DESC, event_id DESC) AS rn FROM p_serve) WHERE rn = 1)
SELECT DISTINCT user_id, received_date AS alert_time, round(risk_score, 6) AS risk_score,
       round(uncertainty, 6) AS uncertainty FROM dl WHERE risk_score >= 0.7""")
def q_append_alerts(spark, d):
    """Daily alert logging run twice over the same days (before the cutoff,
    then all days): the log holds every alert once."""
    from vitalgrid.plans.q_serving import day_alerts
    path = scratch(spark, "alert-log")
    IO.append_alerts(day_alerts(spark, d).filter(F.col("alert_time") < F.lit(CUTOFF).cast("timestamp")), path)
    IO.append_alerts(day_alerts(spark, d), path)
    IO.append_alerts(day_alerts(spark, d), path)
    return rounded(IO.read_alerts(spark, path))


@query("stream_alerts", X.P_SERVE_SQL + """,
b AS (SELECT *, received_date >= TIMESTAMP '""" + CUTOFF + """' AS second FROM p_serve),
lat AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, second ORDER BY received_date DESC, event_id DESC) AS rn
  FROM b) WHERE rn = 1)
SELECT DISTINCT user_id, received_date AS alert_time, round(risk_score, 6) AS risk_score,
       round(uncertainty, 6) AS uncertainty FROM lat WHERE risk_score >= 0.7""")
def q_stream_alerts(spark, d):
    """Serving rows arrive in two deliveries (before / from the cutoff); the
    alert stream processes each and logs the latest high-risk row per entity
    and batch."""
    from vitalgrid.streaming.alerts import run_alert_stream
    src, log, ck = scratch(spark, "serving-src"), scratch(spark, "stream-log"), scratch(spark, "stream-ckpt")
    s = X.p_serve(spark, d)
    s.filter(F.col(R) < F.lit(CUTOFF).cast("timestamp")).write.mode("append").parquet(os.path.join(src, "part1"))
    run_alert_stream(spark, src + "/*", log, SERVE_SCHEMA, tie=("event_id",), checkpoint=ck)
    s.filter(F.col(R) >= F.lit(CUTOFF).cast("timestamp")).write.mode("append").parquet(os.path.join(src, "part2"))
    # same checkpoint: the second run sees only the new delivery
    run_alert_stream(spark, src + "/*", log, SERVE_SCHEMA, tie=("event_id",), checkpoint=ck)
    return rounded(IO.read_alerts(spark, log))


@query("latest_serving_alerts", X.P_SERVE_SQL + """,
lat AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY received_date DESC, event_id DESC) AS rn
  FROM p_serve) WHERE rn = 1)
SELECT user_id, received_date AS alert_time, round(risk_score, 6) AS risk_score, round(uncertainty, 6) AS uncertainty
FROM lat WHERE risk_score >= 0.7""")
def q_latest_serving_alerts(spark, d):
    """Serving table written and read back through ``read_serving``, then the
    latest row per entity -> alerts."""
    path = scratch(spark, "serving")
    X.p_serve(spark, d).write.parquet(path)
    s = IO.read_serving(spark, path, SERVE_SCHEMA)
    return rounded(V.new_alerts(V.latest_row(s, E, R, required=["risk_score"], tie=["event_id"]), E, R))
