"""Node tables against the models they come from."""

import numpy as np
from pyspark.sql import functions as F

from vitalgrid.operators import models as MD
from vitalgrid.operators.trees import ensemble, node_table


def planted(spark, n=1200):
    df = spark.range(n).select("id", F.sin("id").alias("a"), F.cos(F.col("id") * 3).alias("b"))
    return df.withColumn("label", ((F.col("a") + 0.5 * F.col("b") + 0.3 * F.sin(F.col("id") * 17)) > 0.2).cast("int"))


def test_round_trip_keeps_scores_and_importances(spark):
    df, cols = planted(spark), ["a", "b"]
    forest = MD.fit_forest(df, cols, "label", num_trees=6, max_depth=6, seed=2)
    again = ensemble(node_table(forest, spark), "forest", 2, 6)
    x = [r[0] for r in MD.score(forest, df, cols).orderBy("id").select("risk_score").collect()]
    y = [r[0] for r in MD.score(again, df, cols).orderBy("id").select("risk_score").collect()]
    np.testing.assert_allclose(x, y, atol=1e-12)
    np.testing.assert_allclose(forest.featureImportances.toArray(), again.featureImportances.toArray(), atol=1e-9)


def test_spread_equals_a_walk_by_hand(spark):
    df, cols = planted(spark, 300), ["a", "b"]
    forest = MD.fit_forest(df, cols, "label", num_trees=5, max_depth=4, seed=3)
    nodes = {(r["tree"], r["node"]): r for r in node_table(forest, spark).collect()}

    def tree(t, x):
        n = nodes[t, 0]
        while n["left"] >= 0:
            n = nodes[t, n["left"] if x[n["feature"]] <= n["threshold"] else n["right"]]
        return n["value"]

    for r in MD.tree_uncertainty(forest, df, cols).collect():
        p = [tree(t, (r["a"], r["b"])) for t in range(5)]
        assert abs(r["risk_score"] - np.mean(p)) < 1e-12 and abs(r["uncertainty"] - np.std(p)) < 1e-7


def test_spread_needs_no_python(spark):
    df, cols = planted(spark, 100), ["a", "b"]
    forest = MD.fit_forest(df, cols, "label", num_trees=3, max_depth=3)
    plan = MD.tree_uncertainty(forest, df, cols)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_one_class(spark):
    df = spark.range(50).select("id", F.lit(1.0).alias("a"), F.lit(0).alias("label"))
    forest = MD.fit_forest(df, ["a"], "label", num_trees=2, max_depth=2)
    got = MD.tree_uncertainty(forest, df, ["a"]).agg(F.max("risk_score"), F.max("uncertainty")).first()
    assert tuple(got) == (0.0, 0.0)


def test_probability_column_of_the_caller_stays(spark):
    df = planted(spark, 100).withColumn("probability", F.lit("mine"))
    forest = MD.fit_forest(df.drop("probability"), ["a", "b"], "label", num_trees=2, max_depth=2)
    assert MD.tree_uncertainty(forest, df, ["a", "b"]).select("probability").first()[0] == "mine"
