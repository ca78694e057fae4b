"""Serving operators on hand-made frames."""

import datetime as dt

from vitalgrid.operators import filters as FL
from vitalgrid.operators import serving as V

T0 = dt.datetime(2024, 1, 1)


def test_latest_row_falls_back_to_last_complete(spark):
    rows = [(1, T0, 0.5, 0.1), (1, T0 + dt.timedelta(minutes=1), None, 0.2), (2, T0, None, None)]
    df = spark.createDataFrame(rows, "e long, ts timestamp, risk_score double, uncertainty double")
    out = {r["e"]: r for r in V.latest_row(df, "e", "ts", required=["risk_score"]).collect()}
    assert set(out) == {1} and out[1]["risk_score"] == 0.5
    plain = {r["e"]: r for r in V.latest_row(df, "e", "ts").collect()}
    assert plain[1]["uncertainty"] == 0.2 and 2 in plain


def test_risk_band_edges(spark):
    df = spark.createDataFrame([(0.39999,), (0.4,), (0.69999,), (0.7,), (None,)], "risk_score double")
    got = [r["risk_band"] for r in FL.risk_band(df).collect()]
    assert got == ["Low", "Medium", "Medium", "High", None]


def test_top_k_ties_and_missing(spark):
    df = spark.createDataFrame([(1.0, 1.0, None, 2.0), (None, None, None, None)], "a double, b double, c double, d double")
    w = {"a": 1.0, "b": 1.0, "c": 5.0, "d": 0.25}
    out = V.top_k_factors(df, {s: s for s in "abcd"}, w, k=3, names={s: s.upper() for s in "abcd"}).collect()
    assert [out[0][f"top_factor_{i}"] for i in (1, 2, 3)] == ["A", "B", "D"]   # tie a/b by order, c missing last
    assert [out[1][f"top_factor_{i}"] for i in (1, 2, 3)] == ["A", "B", "C"]
    assert len({out[0][f"top_factor_{i}"] for i in (1, 2, 3)}) == 3


def test_downsample_drops_incomplete_bins_and_keeps_last_factor(spark):
    rows = [(1, T0, 1.0, "X"), (1, T0 + dt.timedelta(minutes=5), 3.0, None),
            (1, T0 + dt.timedelta(minutes=20), None, "Y")]
    df = spark.createDataFrame(rows, "e long, ts timestamp, v double, f string")
    out = V.downsample(df, "e", "ts", "15 minutes", ["v"], ["f"]).collect()
    assert len(out) == 1 and out[0]["v"] == 2.0 and out[0]["f"] == "X"


def test_alerts_inclusive_and_idempotent(spark):
    rows = [(1, T0, 0.7, 0.1), (2, T0, 0.69, 0.1)]
    df = spark.createDataFrame(rows, "e long, ts timestamp, risk_score double, uncertainty double")
    new = V.new_alerts(df, "e", "ts")
    assert [r["e"] for r in new.collect()] == [1]
    assert V.unlogged_alerts(new, new, "e").count() == 0


def test_band_limits_and_normalise(spark):
    df = spark.createDataFrame([(1, 0.9, 0.2, 5.0), (1, 0.1, 0.3, 5.0)], "e long, risk_score double, uncertainty double, v double")
    lim = V.risk_band_limits(df).orderBy("risk_score").collect()
    assert lim[0]["lower"] == 0.0 and lim[1]["upper"] == 1.0
    n = V.minmax_normalise(df, "e", ["v"]).collect()
    assert all(r["v_norm"] == 0.0 for r in n)     # zero span divides by 1


def test_reduction_report(spark):
    a, b = spark.range(345680), spark.range(23120)
    r = V.reduction_report(a, b).first()
    assert (r["rows_before"], r["rows_after"], r["reduction_percent"]) == (345680, 23120, 93.31)


def test_alert_history_newest_first(spark):
    rows = [(1, T0, 0.8, 0.1), (1, T0 + dt.timedelta(days=1), 0.9, 0.1), (2, T0, 0.75, 0.2)]
    a = spark.createDataFrame(rows, "user_id long, alert_time timestamp, risk_score double, uncertainty double")
    one = [r["risk_score"] for r in V.alert_history(a, "user_id", 1).collect()]
    assert one == [0.9, 0.8]
    every = [(r["user_id"], r["risk_score"]) for r in V.alert_history(a, "user_id").collect()]
    assert every == [(1, 0.9), (1, 0.8), (2, 0.75)]


def test_entity_summary_text(spark):
    rows = [(1, T0, 0.734, 0.2, 71.6, "SpO2", None, "Steps"), (2, T0, 0.4, 0.55, 60.2, None, None, None)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, risk_score double, uncertainty double, "
                                     "heart_rate double, top_factor_1 string, top_factor_2 string, top_factor_3 string")
    out = {r["user_id"]: r for r in V.entity_summary(df, "user_id", "ts", vitals=["heart_rate"],
                                                     factors=["top_factor_1", "top_factor_2", "top_factor_3"]).collect()}
    assert (out[1]["risk_pct"], out[1]["risk_band"], out[1]["confidence_pct"]) == ("73%", "High", "80%")
    assert out[1]["main_factors"] == "SpO2, Steps" and out[1]["heart_rate_shown"] == 72.0
    assert (out[2]["risk_pct"], out[2]["risk_band"], out[2]["main_factors"]) == ("40%", "Medium", "")
