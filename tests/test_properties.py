"""Property test: the fused chunked operator equals brute force for random
series, window sizes, horizons and (tiny) chunk sizes."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vitalgrid.operators import sequence as S

T0 = dt.datetime(2024, 1, 1)


def brute(vals, flags, rows, horizon, sus):
    n = len(vals)
    trend, sflag, label = [], [], []
    for i in range(n):
        win = [v for v in vals[max(0, i - rows + 1):i + 1] if v is not None]
        trend.append(sum(win) / len(win) if win else None)
    target = flags
    if sus:
        sflag = [i >= sus - 1 and all(flags[i - sus + 1:i + 1]) for i in range(n)]
        target = sflag
    label = [int(any(target[i:i + horizon])) for i in range(n)]
    return trend, sflag, label


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.data())
def test_trend_and_label_matches_brute_force(spark, data):
    n = data.draw(st.integers(1, 30))
    vals = data.draw(st.lists(st.one_of(st.none(), st.floats(-5, 5)), min_size=n, max_size=n))
    flags = data.draw(st.lists(st.booleans(), min_size=n, max_size=n))
    rows = data.draw(st.integers(1, 6))
    horizon = data.draw(st.integers(1, 8))
    sus = data.draw(st.one_of(st.none(), st.integers(1, 4)))
    chunk = data.draw(st.integers(1, 9))
    df = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=i), vals[i], flags[i], i + 1) for i in range(n)],
                               "e long, ts timestamp, v double, f boolean, rn long")
    out = S.trend_and_label(df, "e", "rn", ["v"], rows, "f", horizon, sustained_rows=sus, chunk_rows=chunk)
    got = out.orderBy("rn").collect()
    trend, sflag, label = brute(vals, flags, rows, horizon, sus)
    assert len(got) == n
    for r, t, la in zip(got, trend, label):
        assert (r["v_trend"] is None and t is None) or abs(r["v_trend"] - t) < 1e-9
        assert r["target_future_risk"] == la
    if sus:
        assert [r["sustained_event"] for r in got] == sflag
