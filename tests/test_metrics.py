"""Exact metrics against brute force (ties included) and invariants."""

import random

from pyspark.sql import functions as F

from vitalgrid.operators import metrics as M
from vitalgrid.operators.aggregates import exact_median, median_split


def data(spark, n=300, seed=0, levels=15):
    rnd = random.Random(seed)
    rows = [(i, float(rnd.randint(0, levels)), int(rnd.random() < 0.35)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, s double, y int")


def brute_auroc(rows):
    pos = [s for _, s, y in rows if y == 1]
    neg = [s for _, s, y in rows if y == 0]
    tot = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


def brute_ap(rows):
    P = sum(y for *_, y in rows)
    ap, prev_r = 0.0, 0.0
    for t in sorted({s for _, s, _ in rows}, reverse=True):
        tp = sum(1 for _, s, y in rows if s >= t and y == 1)
        fp = sum(1 for _, s, y in rows if s >= t and y == 0)
        r = tp / P
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return ap


def test_auroc_and_ap_match_brute_force(spark):
    for seed, levels in [(0, 15), (1, 3), (2, 1000)]:
        rows, df = data(spark, seed=seed, levels=levels)
        a = M.auroc(df, "s", "y", out="a").first()["a"]
        p = M.average_precision(df, "s", "y", out="p").first()["p"]
        assert abs(a - brute_auroc(rows)) < 1e-12
        assert abs(p - brute_ap(rows)) < 1e-12


def test_auroc_of_negated_score(spark):
    _, df = data(spark, seed=4)
    a = M.auroc(df, "s", "y").first()[0]
    b = M.auroc(df.withColumn("s", -F.col("s")), "s", "y").first()[0]
    assert abs(a + b - 1.0) < 1e-12


def test_grouped_metrics_and_many_buckets(spark):
    rows, df = data(spark, seed=7, levels=200)
    long = df.withColumn("m", F.lit("a")).unionByName(df.withColumn("m", F.lit("b")).withColumn("s", -F.col("s")))
    t = {r["m"]: r for r in M.model_table(long, "m", "s", "y").collect()}
    assert abs(t["a"]["auroc"] - brute_auroc(rows)) < 1e-12
    assert abs(t["a"]["auroc"] + t["b"]["auroc"] - 1) < 1e-12
    # more buckets than distinct scores, and a single bucket, give the same result
    from vitalgrid.operators.ranking import running_totals
    g = M.score_counts(df, "s", "y")
    one = {r["s"]: r["cum_neg"] for r in running_totals(g, "s", ["neg"], n_buckets=1).collect()}
    many = {r["s"]: r["cum_neg"] for r in running_totals(g, "s", ["neg"], n_buckets=64).collect()}
    assert one == many


def test_brier_accuracy_class_report(spark):
    df = spark.createDataFrame([(0.9, 1, 1), (0.2, 0, 0), (0.6, 0, 1), (0.4, 1, 0)], "p double, y int, pred int")
    assert abs(M.brier(df, "p", "y").first()[0] - (0.01 + 0.04 + 0.36 + 0.36) / 4) < 1e-12
    assert M.accuracy(df, "pred", "y").first()[0] == 0.5
    rep = {r["class"]: r for r in M.class_report(df, "pred", "y").collect()}
    assert rep["1"]["precision"] == 0.5 and rep["1"]["recall"] == 0.5 and rep["1"]["support"] == 2
    assert rep["accuracy"]["f1_score"] == 0.5 and rep["macro avg"]["f1_score"] == 0.5


def test_class_report_zero_division(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (0, 0)], "y int, pred int")
    rep = {r["class"]: r for r in M.class_report(df, "pred", "y").collect()}
    assert rep["1"]["precision"] == 0.0 and rep["1"]["f1_score"] == 0.0


def test_exact_median_even_and_odd(spark):
    for vals, med in [([5.0, 1.0, 3.0], 3.0), ([4.0, 1.0, 3.0, 10.0], 3.5), ([2.0, 2.0, 2.0, 7.0], 2.0)]:
        df = spark.createDataFrame([(v,) for v in vals], "x double")
        assert df.select(exact_median(df, "x")).first()[0] == med
    df = spark.createDataFrame([(v,) for v in [1.0, 2.0, 3.0, 4.0]], "x double")
    assert [r["t"] for r in median_split(df, "x", "t").orderBy("x").collect()] == [0, 0, 1, 1]
