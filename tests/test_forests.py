"""Forests grown in tasks: every split is the best one, limits hold, and the deep search needs no fit of Spark ML."""

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import functions as F

from vitalgrid.operators import forests as FO
from vitalgrid.operators import models as MD
from vitalgrid.operators.metrics import auroc


def made(n: int = 600, features: int = 3, seed: int = 5):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (features, n)).astype(np.uint8)
    y = (rng.random(n) < 0.2 + 0.05 * x[0]).astype(float)
    return x, y, np.where(y > 0, 0.8, 1.3)


def gini(y, w):
    p = (w * y).sum() / w.sum()
    return 2 * p * (1 - p)


def rows_of(tree, bins):
    """Rows of every node by a plain walk."""
    out, stack = {}, [(0, np.arange(bins.shape[1]))]
    while stack:
        node, rows = stack.pop()
        out[node] = rows
        if tree.left[node] >= 0:
            goes = bins[tree.feature[node], rows] <= tree.bin[node]
            stack += [(tree.left[node], rows[goes]), (tree.right[node], rows[~goes])]
    return out


def test_every_split_is_the_best_of_a_plain_loop():
    bins, y, w = made()
    spec = FO.Spec(max_depth=6, min_rows=3, features="all", seed=7)
    tree = FO.grow(bins, y, w, spec, 2)
    drawn = np.random.default_rng([7, 2]).poisson(1.0, len(y))
    members, levels = rows_of(tree, bins), {0: 0}
    assert len(tree.left) > 20
    for node, rows in sorted(members.items()):
        n, ww, yy = drawn[rows], drawn[rows] * w[rows], y[rows]
        assert np.isclose(tree.rows[node], ww.sum()) and np.isclose(tree.value[node], (ww * yy).sum() / ww.sum())
        best = 0.0
        for f in range(len(bins)):
            for b in range(12):
                goes = bins[f, rows] <= b
                if min(n[goes].sum(), n[~goes].sum()) >= spec.min_rows:
                    shares = [ww[g].sum() / ww.sum() * gini(yy[g], ww[g]) for g in (goes, ~goes)]
                    best = max(best, gini(yy, ww) - sum(shares))
        if tree.left[node] >= 0:
            assert abs(tree.gain[node] - best) < 1e-9
            levels[tree.left[node]] = levels[tree.right[node]] = levels[node] + 1
        else:
            assert best < 1e-9 or levels[node] == spec.max_depth
    assert max(levels.values()) == 6


def test_a_node_looks_at_its_subset_only():
    bins, y, w = made(features=9)
    spec = FO.Spec(max_depth=1, seed=3)
    used = {int(FO.grow(bins, y, w, spec, t).feature[0]) for t in range(40)}
    assert spec.subset(9) == 3 and FO.Spec(features="log2").subset(9) == 4 and FO.Spec(features="all").subset(9) == 9
    assert len(used) >= 3 and 0 in used


def frame(spark, n: int = 1500):
    u = [(F.abs(F.hash(F.col("id"), F.lit(i))) % 1000) / 1000 for i in range(3)]
    df = spark.range(n).select("id", u[0].alias("a"), (u[1] * 3).cast("int").alias("b"), u[2].alias("u"))
    return df.withColumn("label", (F.col("u") < 0.1 + 0.8 * F.col("a")).cast("int"))


def test_model_scores_as_the_trees_do_and_beside_spark(spark):
    df = frame(spark)
    m = MD.grow_forest(df, ["a", "b"], "label", num_trees=30, max_depth=4)
    assert isinstance(m, RandomForestClassificationModel) and len(m.treeWeights) == 30
    got = MD.auroc_value(MD.score(m, df, ["a", "b"]), "label")
    spark_ml = MD.auroc_value(MD.score(MD.fit_forest(df, ["a", "b"], "label", 30, 4), df, ["a", "b"]), "label")
    assert abs(got - spark_ml) < 0.03
    again = MD.grow_forest(df.repartition(7), ["a", "b"], "label", num_trees=30, max_depth=4)
    assert again.totalNumNodes == m.totalNumNodes
    s = MD.score(m, df, ["a", "b"]).orderBy("id").select("risk_score").toPandas()
    t = MD.score(again, df, ["a", "b"]).orderBy("id").select("risk_score").toPandas()
    assert np.allclose(s, t)


def test_held_scores_equal_a_model_without_the_fold(spark):
    df = frame(spark).withColumn("f", (F.col("id") % 3).cast("int")).withColumn("w", F.lit(1.0))
    table = FO.Table(df, ["a", "b"], "label", "w", fold="f")
    spec = FO.Spec(trees=30, max_depth=5, left_out=1)
    held = table.held_scores([spec]).toPandas()
    m = table.fit([spec])[0]
    told = MD.score(m, df.filter("f = 1"), ["a", "b"]).select("label", "risk_score").toPandas()
    assert np.allclose(np.sort(held["risk_score"]), np.sort(told["risk_score"]))
    assert abs(auroc(table.held_scores([spec]), "risk_score", "label").first()[0]
               - auroc(spark.createDataFrame(told), "risk_score", "label").first()[0]) < 1e-9
    assert [len(b) for b in table.bounds] == [63, 2]


def test_one_class_and_one_row(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0)], "a double, label int")
    assert {r["risk_score"] for r in MD.score(MD.grow_forest(df, ["a"], "label", 3, 2), df, ["a"]).collect()} == {0.0}
    one = df.limit(1)
    assert MD.score(MD.grow_forest(one, ["a"], "label", 3, 2), one, ["a"]).count() == 1


def test_search_and_untuned_forest_without_spark_mls_fit(spark, monkeypatch):
    """Forests without a depth limit on noise: none is grown by Spark ML, whose sums of every open node do not end in time."""
    def refuse(*_):
        raise AssertionError("Spark ML's forest is fitted")

    monkeypatch.setattr(RandomForestClassifier, "_fit", refuse)
    df = frame(spark, 1000).withColumn("label", (F.col("u") < 0.5).cast("int"))
    best, table = MD.random_search(df, ["a", "b"], "label", kind="rf", n_iter=3, folds=2, key="id")
    assert table.count() == 3 and all(0.4 < r["cv_auroc"] < 0.6 for r in table.collect())
    assert str({"n_estimators": len(best.treeWeights)})[1:-1] in table.first()["params"]
    MD.grow_forest(df, ["a", "b"], "label", 5, 30)
