"""Running totals and ranks over ranges: exact, one read of the input, no job while the plan is built."""

import re

import numpy as np
from pyspark.sql import functions as F

from vitalgrid.operators import metrics as M
from vitalgrid.operators.aggregates import median_split
from vitalgrid.operators.ranking import hash_digits, running_totals


def scores(spark, n=20_000):
    df = spark.range(n).select("id", F.round(F.sin("id"), 3).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    return df.withColumn("g", F.col("id") % 2)


def jobs_of(spark, group, build):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return build(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_running_totals_are_exact(spark):
    t = scores(spark).groupBy("g", "score").agg(F.sum("label").alias("n"), F.count("*").alias("m"))
    for down in (False, True):
        got = running_totals(t, "score", ["n"], descending=down, by=["g"], n_buckets=7).collect()
        for g in (0, 1):
            rows = sorted((r for r in got if r["g"] == g), key=lambda r: r["score"], reverse=down)
            assert [r["cum_n"] for r in rows] == np.cumsum([r["n"] for r in rows]).tolist()


def test_metrics_read_their_scores_once_and_plan_without_a_job(spark, tmp_path):
    path = str(tmp_path / "scores")
    scores(spark).write.parquet(path)
    df = spark.read.parquet(path)
    for name, build in (("auroc", lambda: M.auroc(df, "score", "label")),
                        ("ap", lambda: M.average_precision(df, "score", "label")),
                        ("both", lambda: M.ranking_metrics(df, "score", "label", by="g"))):
        out, jobs = jobs_of(spark, f"plan-{name}", build)
        assert jobs == 0, name
        plan = final_plan(out)
        assert len(re.findall(r"Scan parquet", plan)) - len(re.findall("ReusedExchange", plan)) <= 1, plan


def test_median_split_plans_without_a_job(spark):
    df = scores(spark)
    out, jobs = jobs_of(spark, "median", lambda: median_split(df, "score"))
    assert jobs == 0
    values = np.sort([r[0] for r in df.select("score").collect()])
    got = out.groupBy("target").count().collect()
    assert {r["target"]: r["count"] for r in got} == {1: int((values > np.median(values)).sum()),
                                                      0: int((values <= np.median(values)).sum())}


def test_buckets_grow_with_the_session(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "100000")
        assert 16 ** hash_digits(spark.range(1)) >= 1_600_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_samples_are_filters_and_exact(spark, monkeypatch):
    from vitalgrid.operators import splits as SP
    df = spark.range(30_000).select((F.col("id") % 10_000).alias("k"), (F.col("id") / 10_000).cast("int").alias("j"), "id")
    keyed = df.withColumn("_h", SP.stable_hash_key("k", "j", 5)).collect()
    rows = [r["id"] for r in sorted(keyed, key=lambda r: (r["_h"], r["k"], r["j"]))]
    for n, cut in ((1, 100_000), (777, 100_000), (29_999, 100_000), (5_000, 0), (30_000, 1), (40_000, 100_000), (0, 1)):
        monkeypatch.setattr(SP, "CUT_ROWS", cut)
        got = SP.sample_n(df, ["k", "j"], n, seed=5)
        assert {r["id"] for r in got.collect()} == set(rows[:n]) and got.count() == min(n, 30_000)
    assert "Exchange" not in SP.sample_n(df, ["k", "j"], 777, seed=5)._jdf.queryExecution().executedPlan().toString()


def test_samples_of_repeated_rows(spark, monkeypatch):
    from vitalgrid.operators import splits as SP
    df = spark.range(1000).select((F.col("id") % 3).alias("k"))
    for n in (1, 333, 334, 500, 999):
        assert SP.sample_n(df, "k", n).count() == n
    nulls = spark.range(50).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"), "id")
    assert SP.sample_n(nulls, "k", 20).count() == 20 and SP.sample_n(nulls, "k", 40).count() == 40
    assert SP.sample_n(nulls.limit(0), "k", 5).count() == 0
