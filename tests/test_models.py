"""Model invariants: per-tree moments, isolation forest on planted outliers."""

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vitalgrid.operators import models as MD
from vitalgrid.operators.isolation import c_factor, fit_isolation_forest, score_isolation_forest
from vitalgrid.operators.metrics import auroc


def planted(spark, n=3000):
    """Two features; label 1 when x + noise is large; rows 0..29 are far outliers."""
    x = F.sin(F.col("id") * 12.9898) * 43758.5453
    x = x - F.floor(x)
    y = F.cos(F.col("id") * 78.233) * 12345.678
    y = y - F.floor(y)
    df = spark.range(n).select("id", x.alias("a"), y.alias("b"))
    df = df.withColumn("a", F.when(F.col("id") < 30, F.col("a") + 8.0).otherwise(F.col("a")))
    return df.withColumn("label", ((F.col("a") + 0.3 * F.col("b")) > 0.8).cast("int"))


def test_tree_uncertainty_mean_equals_forest_probability(spark):
    df = planted(spark)
    m = MD.fit_forest(df, ["a", "b"], "label", num_trees=12, max_depth=5, seed=3)
    u = MD.tree_uncertainty(m, df, ["a", "b"])
    p = m.transform(MD.assemble(df, ["a", "b"])).select("id", vector_to_array("probability")[1].alias("p"))
    j = u.join(p, "id").select(F.max(F.abs(F.col("risk_score") - F.col("p"))).alias("d"),
                               F.min("uncertainty").alias("lo"), F.max("uncertainty").alias("hi")).first()
    assert j["d"] < 1e-12 and j["lo"] >= 0 and j["hi"] <= 0.5


def test_leaf_table_reproduces_forest_mean(spark):
    """mean of the looked-up leaf probabilities == forest probability (leaf order check)."""
    df = planted(spark, 800)
    m = MD.fit_forest(df, ["a", "b"], "label", num_trees=5, max_depth=4, seed=1, balanced=False)
    u = MD.tree_uncertainty(m, df, ["a", "b"])
    sc = MD.score(m, df, ["a", "b"])
    d = u.join(sc.withColumnRenamed("risk_score", "p2"), "id").select(
        F.max(F.abs(F.col("risk_score") - F.col("p2")))).first()[0]
    assert d < 1e-12


def test_isolation_forest_finds_outliers(spark):
    df = planted(spark).withColumn("out", (F.col("id") < 30).cast("int"))
    iso = fit_isolation_forest(df, ["a", "b"], key="id", n_trees=50, sample_size=128, seed=7)
    s = score_isolation_forest(iso, df, ["a", "b"])
    assert auroc(s, "anomaly_score", "out").first()[0] > 0.95
    assert abs(c_factor(256) - 10.244770) < 1e-5 and c_factor(2) == 1.0 and c_factor(1) == 0.0


def test_logistic_learns_signal(spark):
    df = planted(spark)
    m = MD.fit_logistic(df, ["a", "b"], "label")
    s = MD.score(m, df, ["a", "b"])
    assert auroc(s, "risk_score", "label").first()[0] > 0.9
    assert not math.isnan(m.intercept)


def test_signal_importance_sums(spark):
    df = planted(spark).withColumn("a_zscore", F.col("a")).withColumn("b_zscore", F.col("b"))
    cols = ["a", "b", "a_zscore", "b_zscore"]
    m = MD.fit_forest(df, cols, "label", num_trees=5, max_depth=4)
    imp = MD.signal_importance(m, cols, ["a", "b"])
    assert abs(sum(imp.values()) - 1.0) < 1e-9 and imp["a"] > imp["b"]
