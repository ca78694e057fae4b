"""Personal baselines on edge frames: constant signal, one-row entity, NaN."""

from pyspark.sql import functions as F

from vitalgrid.functions.scalar import nan_to_null
from vitalgrid.operators import baselines as B


def test_constant_and_one_row_entities_give_no_event(spark):
    rows = [(1, 5.0), (1, 5.0), (1, 5.0), (2, 7.0), (3, 1.0), (3, 9.0), (3, 1.0), (3, 1.0)]
    df = spark.createDataFrame(rows, "e long, v double")
    out = B.any_exceeds(B.zscore(df, "e", ["v"]), ["v_zscore"], 1.0).collect()
    by = {}
    for r in out:
        by.setdefault(r["e"], []).append(r)
    assert all(r["v_zscore"] is None and not r["risk_event_now"] for r in by[1])   # std 0
    assert by[2][0]["v_zscore"] is None and not by[2][0]["risk_event_now"]          # one row: std NULL
    assert sum(r["risk_event_now"] for r in by[3]) == 1                             # the 9.0 stands out


def test_sample_std_and_population_std(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0)], "e long, v double")
    s1 = B.entity_stats(df, "e", ["v"], ddof=1).first()
    s0 = B.entity_stats(df, "e", ["v"], ddof=0).first()
    assert abs(s1["v_std"] - 2 ** 0.5) < 1e-12 and s0["v_std"] == 1.0


def test_nan_is_missing_not_an_exceedance(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, 1.0), (1, 2.0)], "e long, v double")
    df = df.withColumn("v", nan_to_null("v"))
    z = B.any_exceeds(B.zscore(df, "e", ["v"]), ["v_zscore"], 0.1)
    assert [r["risk_event_now"] for r in z.orderBy(F.col("v").asc_nulls_first()).collect()] == [False, True, True]


def test_attach_group_agg_matches_join(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0)], "e long, v double")
    out = B.attach_group_agg(df, "e", {"m": F.avg("v"), "n": F.count(F.lit(1))})
    assert sorted((r["e"], r["m"], r["n"]) for r in out.collect()) == [(1, 2.0, 2), (1, 2.0, 2), (2, 5.0, 1)]
