"""Sources, sinks, gates and the alert stream on small frames."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.sources import io as IO
from vitalgrid.streaming.alerts import run_alert_stream

T0 = dt.datetime(2024, 1, 1, 8, 0, 0)
SCHEMA = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("received_date", T.TimestampType()),
                       T.StructField("risk_score", T.DoubleType()), T.StructField("uncertainty", T.DoubleType())])


def fresh():
    return tempfile.mkdtemp(prefix="vitalgrid-test-io-")


def test_day_first_csv_round_trip_and_projection(spark):
    path = os.path.join(fresh(), "p.csv")
    with open(path, "w") as f:
        f.write("user_id,received_date,heart_rate\n1,02/01/2024 10:11:12,61.5\n1,02/01/2024 10:12:12,NaN\n")
    schema = IO.panel_schema("user_id", "received_date", ["heart_rate"])
    df = IO.read_panel(spark, path, "csv", IO.TS_DAY_FIRST, schema)
    rows = df.orderBy("received_date").collect()
    assert rows[0]["received_date"] == dt.datetime(2024, 1, 2, 10, 11, 12)
    assert rows[1]["heart_rate"] is None                      # NaN -> NULL at the source
    only = IO.read_panel(spark, path, "csv", IO.TS_DAY_FIRST, schema, columns=["user_id"])
    assert only.columns == ["user_id"]


def test_require_complete_raises(spark):
    df = spark.createDataFrame([(1, T0)], "user_id long, received_date timestamp")
    with pytest.raises(ValueError):
        IO.require_complete(df, ["user_id", "heart_rate"], "user_id")
    with pytest.raises(ValueError):
        IO.require_complete(df, ["user_id"], "user_id", min_entities=70)
    assert IO.require_complete(df, ["user_id"], "user_id").first()["complete"]


def test_append_alerts_idempotent(spark):
    log = os.path.join(fresh(), "alerts")
    a = spark.createDataFrame([(1, T0, 0.8, 0.1), (2, T0, 0.9, 0.2)], SCHEMA).withColumnRenamed(
        "received_date", "alert_time")
    assert IO.append_alerts(a, log) == 2
    assert IO.append_alerts(a, log) == 0
    assert IO.read_alerts(spark, log).count() == 2


def test_write_panel_and_drop_leading_rows(spark):
    out = os.path.join(fresh(), "panel")
    df = spark.range(100).selectExpr("id % 3 AS user_id", "timestamp_seconds(id * 60) AS ts")
    IO.write_panel(df, out, "user_id", "ts", files=4)
    back = spark.read.parquet(out)
    assert back.count() == 100
    assert IO.drop_leading_rows(back, ["user_id", "ts"], 5).count() == 95


def test_alert_stream_exactly_once(spark):
    root = fresh()
    src, log, ck = os.path.join(root, "src"), os.path.join(root, "log"), os.path.join(root, "ck")
    b1 = spark.createDataFrame([(1, T0, 0.5, 0.1), (1, T0 + dt.timedelta(minutes=1), 0.75, 0.1),
                                (2, T0, 0.9, 0.3)], SCHEMA)
    b1.write.parquet(os.path.join(src, "d1"))
    assert run_alert_stream(spark, src + "/*", log, SCHEMA, checkpoint=ck) == 2
    assert run_alert_stream(spark, src + "/*", log, SCHEMA, checkpoint=ck) == 0    # nothing new
    b2 = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=2), 0.3, 0.1)], SCHEMA)
    b2.write.parquet(os.path.join(src, "d2"))
    assert run_alert_stream(spark, src + "/*", log, SCHEMA, checkpoint=ck) == 0    # latest row is low risk
    got = sorted((r["user_id"], r["risk_score"]) for r in IO.read_alerts(spark, log).collect())
    assert got == [(1, 0.75), (2, 0.9)]


def test_panel_files_follow_the_bytes(spark, tmp_path):
    """A third of the rows are one entity's, and many of them share one time: no file is much larger than asked for."""
    import os
    n = 120_000
    hot = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500)
    ts = F.when(F.col("id") % 6 == 0, 0).otherwise(F.col("id"))
    df = spark.range(n).select(hot.alias("user_id"), F.timestamp_seconds(ts).alias("ts"), F.sha2(F.col("id").cast("string"), 256)
                               .alias("value"))
    for size in (300_000, 1 << 30):
        out = str(tmp_path / f"panel-{size}")
        IO.write_panel(df, out, "user_id", "ts", file_bytes=size)
        sizes = [os.path.getsize(os.path.join(out, f)) for f in os.listdir(out) if f.endswith(".parquet")]
        assert max(sizes) < 2 * size and spark.read.parquet(out).count() == n
        assert len(sizes) == 1 if size > 10 ** 9 else len(sizes) > 10


def test_reports_run_their_input_once(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            runs.add(1)
            yield batch

    df = spark.range(0, 10, 1, 1).mapInArrow(count, "id long")
    IO.write_report(df, str(tmp_path), "r")
    IO.write_panel(df.withColumn("ts", F.current_timestamp()), str(tmp_path / "p"), "id", "ts")
    assert runs.value == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "r_csv")).count() == 10
