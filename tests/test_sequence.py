"""Row-frame semantics on hand-made frames, including chunk boundaries."""

import datetime as dt
import random

from pyspark.sql import functions as F

from vitalgrid.operators import sequence as S

T0 = dt.datetime(2024, 1, 1)


def panel(spark, rows):
    """rows: (entity, minute, value or None, flag)"""
    data = [(e, T0 + dt.timedelta(minutes=m), v, f) for e, m, v, f in rows]
    return spark.createDataFrame(data, "e long, ts timestamp, v double, f boolean")


def collect(df, col):
    return [r[col] for r in df.orderBy("e", "ts").collect()]


def test_future_event_includes_current_row(spark):
    df = panel(spark, [(1, i, 0.0, f) for i, f in enumerate([True, False, False, True, False])])
    out = S.future_event(df, "e", ["ts"], "f", horizon=2)
    assert collect(out, "target_future_risk") == [1, 0, 1, 1, 0]


def test_rolling_mean_skips_nulls_min_periods_one(spark):
    df = panel(spark, [(1, 0, 1.0, False), (1, 1, None, False), (1, 2, 3.0, False), (1, 3, None, False),
                       (1, 4, None, False)])
    out = S.rolling_mean(df, "e", ["ts"], ["v"], rows=2)
    assert collect(out, "v_trend") == [1.0, 1.0, 3.0, 3.0, None]


def test_sustained_first_rows_false(spark):
    flags = [True, True, True, False, True, True]
    df = panel(spark, [(1, i, 0.0, f) for i, f in enumerate(flags)])
    out = S.sustained(df, "e", ["ts"], "f", rows=2, out="s")
    assert collect(out, "s") == [False, True, True, False, False, True]


def brute(values, flags, rows, horizon):
    trend, label, sus = [], [], []
    for i in range(len(values)):
        win = [v for v in values[max(0, i - rows + 1):i + 1] if v is not None]
        trend.append(sum(win) / len(win) if win else None)
        label.append(int(any(flags[i:i + horizon])))
        sus.append(i >= rows - 1 and all(flags[i - rows + 1:i + 1]))
    return trend, label, sus


def test_chunked_windows_match_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    expect = {}
    for e in range(3):
        n = rnd.randint(5, 40)
        vals = [None if rnd.random() < 0.2 else rnd.random() for _ in range(n)]
        flags = [rnd.random() < 0.3 for _ in range(n)]
        rows += [(e, i * 7, vals[i], flags[i]) for i in range(n)]
        expect[e] = brute(vals, flags, 3, 4)
    df = panel(spark, rows)
    # tiny chunks force many halo copies across chunk borders
    d = S.row_index(df, "e", ["ts"], bucket="hour")
    d = S.rolling_mean(d, "e", ["ts"], ["v"], rows=3, rn=S.RN, chunk_rows=4)
    d = S.future_event(d, "e", ["ts"], "f", horizon=4, rn=S.RN, chunk_rows=4)
    d = S.sustained(d, "e", ["ts"], "f", rows=3, out="s", rn=S.RN, chunk_rows=4)
    got = d.orderBy("e", "ts").collect()
    for e in range(3):
        mine = [r for r in got if r["e"] == e]
        tr, lab, sus = expect[e]
        assert [r[S.RN] for r in mine] == list(range(1, len(mine) + 1))
        for r, t, la, su in zip(mine, tr, lab, sus):
            assert (r["v_trend"] is None and t is None) or abs(r["v_trend"] - t) < 1e-12
            assert r["target_future_risk"] == la
            assert r["s"] == su


def test_row_index_spans_buckets(spark):
    df = panel(spark, [(1, m, 0.0, False) for m in (0, 30, 61, 130, 190, 250)])
    out = S.row_index(df, "e", ["ts"], bucket="hour")
    assert collect(out, S.RN) == [1, 2, 3, 4, 5, 6]


def test_label_monotone_in_horizon(spark):
    rnd = random.Random(1)
    df = panel(spark, [(1, i, 0.0, rnd.random() < 0.1) for i in range(60)])
    a = collect(S.future_event(df, "e", ["ts"], "f", horizon=3), "target_future_risk")
    b = collect(S.future_event(df, "e", ["ts"], "f", horizon=9), "target_future_risk")
    assert all(x <= y for x, y in zip(a, b))


def test_flag_episodes_split_on_gap(spark):
    df = panel(spark, [(1, 0, 0.0, True), (1, 1, 0.0, True), (1, 3, 0.0, True), (1, 4, 0.0, False),
                       (1, 5, 0.0, True)])
    out = S.flag_episodes(df, "e", "ts", "f", max_gap="1 minute").orderBy("episode_start").collect()
    assert [r["n_rows"] for r in out] == [2, 1, 1]
    assert out[0]["episode_end"] == T0 + dt.timedelta(minutes=1)


def test_sustained_subset_of_event(spark):
    rnd = random.Random(3)
    df = panel(spark, [(1, i, 0.0, rnd.random() < 0.6) for i in range(50)])
    out = S.sustained(df, "e", ["ts"], "f", rows=3, out="s").collect()
    assert all((not r["s"]) or r["f"] for r in out)
    assert F is not None


def test_fused_trend_sustained_label_matches_brute_force(spark):
    rnd = random.Random(11)
    rows, expect = [], {}
    for e in range(4):
        n = rnd.randint(3, 45)
        vals = [None if rnd.random() < 0.2 else rnd.random() for _ in range(n)]
        flags = [rnd.random() < 0.5 for _ in range(n)]
        rows += [(e, i * 3, vals[i], flags[i]) for i in range(n)]
        trend, _, sus = brute(vals, flags, 3, 5)
        sus2 = [i >= 1 and flags[i] and flags[i - 1] for i in range(n)]
        label = [int(any(sus2[i:i + 5])) for i in range(n)]
        expect[e] = (trend, sus2, label)
    d = S.row_index(panel(spark, rows), "e", ["ts"], bucket="hour")
    out = S.trend_and_label(d, "e", S.RN, ["v"], 3, "f", horizon=5, sustained_rows=2, chunk_rows=4)
    got = out.orderBy("e", "ts").collect()
    for e in range(4):
        mine = [r for r in got if r["e"] == e]
        tr, sus, lab = expect[e]
        assert len(mine) == len(tr)
        for r, t, s, la in zip(mine, tr, sus, lab):
            assert (r["v_trend"] is None and t is None) or abs(r["v_trend"] - t) < 1e-12
            assert r["sustained_event"] == s and r["target_future_risk"] == la


def test_row_index_splits_hot_pieces(spark):
    # one entity-hour with 40 rows and a piece limit of 7: numbering stays exact
    rnd = random.Random(9)
    mins = sorted(rnd.sample(range(60), 40))
    df = panel(spark, [(1, m, 0.0, False) for m in mins] + [(2, m, 0.0, False) for m in (5, 70, 130)])
    out = S.row_index(df, "e", ["ts"], bucket="hour", max_piece_rows=7)
    got = out.orderBy("e", "ts").collect()
    assert [r[S.RN] for r in got if r["e"] == 1] == list(range(1, 41))
    assert [r[S.RN] for r in got if r["e"] == 2] == [1, 2, 3]
