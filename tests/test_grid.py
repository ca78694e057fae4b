"""Grid repair on hand-made gaps (1, 5, 6, 20 steps), off-grid rows and duplicates."""

import datetime as dt

import pytest

from vitalgrid.operators import grid as G

T0 = dt.datetime(2024, 1, 1)


def panel(spark, minutes, values=None, entity=1):
    values = values or [float(i) for i in range(len(minutes))]
    data = [(entity, T0 + dt.timedelta(minutes=m), v, v) for m, v in zip(minutes, values)]
    return spark.createDataFrame(data, "e long, ts timestamp, a double, b double")


def test_interpolate_prefix_of_every_inner_gap(spark):
    # [1,_,_,_,_,_,_,_,9,_,_] with limit 5 -> [1,2,3,4,5,6,_,_,9,_,_]: the first five points of
    # the inner gap are filled, the rest of it and the trailing points are not
    vals = [1.0] + [None] * 7 + [9.0, None, None]
    data = [(1, T0 + dt.timedelta(minutes=i), v, v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(data, "e long, ts timestamp, a double, b double")
    out = G.interpolate_limited(df, "e", "ts", ["a"], limit=5)
    got = [r["a"] for r in out.orderBy("ts").collect()]
    assert got == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, None, None, 9.0, None, None]


def test_interpolate_small_only_mode(spark):
    vals = [1.0, None, 3.0] + [None] * 6 + [10.0]
    data = [(1, T0 + dt.timedelta(minutes=i), v, v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(data, "e long, ts timestamp, a double, b double")
    out = G.interpolate_limited(df, "e", "ts", ["a"], limit=5, mode="small_only")
    got = [r["a"] for r in out.orderBy("ts").collect()]
    assert got[1] == 2.0 and got[3:9] == [None] * 6


def test_gaps_and_classification(spark):
    present = [0, 2, 8, 15, 36]   # gaps of 1, 5, 6, 20 missing minutes
    df = panel(spark, present)
    gaps = G.find_gaps(df, "e", "ts", "1 minute", small_max_steps=5).orderBy("start").collect()
    assert [g["duration_steps"] for g in gaps] == [1, 5, 6, 20]
    assert [g["duration_minutes"] for g in gaps] == [1.0, 5.0, 6.0, 20.0]
    assert [g["is_large_gap"] for g in gaps] == [False, False, True, True]
    assert gaps[0]["start"] == gaps[0]["end"] == T0 + dt.timedelta(minutes=1)
    grid = G.reindex_to_grid(df, "e", "ts", "1 minute")
    assert grid.count() == 37                      # (max - min) / step + 1
    assert sum(g["duration_steps"] for g in gaps) + len(present) == 37


def test_off_grid_rows_dropped_and_grid_end(spark):
    data = [(1, T0, 1.0, 1.0), (1, T0 + dt.timedelta(seconds=90), 2.0, 2.0),
            (1, T0 + dt.timedelta(minutes=2), 3.0, 3.0), (1, T0 + dt.timedelta(minutes=4, seconds=30), 4.0, 4.0)]
    df = spark.createDataFrame(data, "e long, ts timestamp, a double, b double")
    grid = G.reindex_to_grid(df, "e", "ts", "1 minute").orderBy("ts").collect()
    assert [r["ts"] for r in grid] == [T0 + dt.timedelta(minutes=i) for i in range(5)]
    assert [r["was_present"] for r in grid] == [True, False, True, False, False]


def test_duplicate_timestamp(spark):
    df = panel(spark, [0, 1, 1, 2], values=[1.0, 2.0, 3.0, 4.0])
    with pytest.raises(Exception):
        G.reindex_to_grid(df, "e", "ts", "1 minute").collect()
    keep = G.reindex_to_grid(df, "e", "ts", "1 minute", on_duplicate="last", order=["ts", "a"])
    assert [r["a"] for r in keep.orderBy("ts").collect()] == [1.0, 3.0, 4.0]


def test_clean_panel_flags(spark):
    # a 2-minute gap is filled; a 7-minute gap: 5 filled + 2 not worn; a present NULL counts as missing
    data = [(1, T0 + dt.timedelta(minutes=m), v) for m, v in [(0, 1.0), (3, 4.0), (11, 12.0), (12, None), (13, 14.0)]]
    df = spark.createDataFrame(data, "e long, ts timestamp, a double")
    c = G.clean_panel(df, "e", "ts", ["a"], "1 minute", limit=5).orderBy("ts").collect()
    assert len(c) == 14
    assert [r["was_missing"] for r in c] == [False, True, True, False] + [True] * 7 + [False, True, False]
    assert [r["device_not_worn"] for r in c] == [False] * 9 + [True, True] + [False] * 3
    assert c[1]["a"] == 2.0 and c[12]["a"] == 13.0
    s = G.fill_summary(G.clean_panel(df, "e", "ts", ["a"], "1 minute", limit=5)).first()
    assert (s["n_rows"], s["n_interpolated"], s["n_not_worn"]) == (14, 8, 2)


def test_gap_summary_zero_rows(spark):
    df = panel(spark, [0, 1, 2], entity=1).unionByName(panel(spark, [0, 3], entity=2))
    s = {r["e"]: r for r in G.gap_summary(G.find_gaps(df, "e", "ts"), df, "e").collect()}
    assert s[1]["n_gaps"] == 0 and s[2]["n_gaps"] == 1 and s[2]["n_small"] == 1


def test_clean_panel_row_number_feeds_features(spark):
    from vitalgrid.operators.features import build_features
    data = [(1, T0 + dt.timedelta(minutes=m), float(m % 7)) for m in [0, 1, 2, 5, 6, 9, 10, 11, 12]]
    df = spark.createDataFrame(data, "e long, ts timestamp, a double")
    c = G.clean_panel(df, "e", "ts", ["a"], "1 minute", limit=1, row_number="rn")
    assert [r["rn"] for r in c.orderBy("ts").collect()] == list(range(1, 14))
    f1 = build_features(c, "e", ["ts"], ["a"], 1.0, 3, 4, rn="rn").orderBy("ts").collect()
    f2 = build_features(c.drop("rn"), "e", ["ts"], ["a"], 1.0, 3, 4).orderBy("ts").collect()
    assert [(r["a_zscore_trend"], r["target_future_risk"]) for r in f1] == \
        [(r["a_zscore_trend"], r["target_future_risk"]) for r in f2]
