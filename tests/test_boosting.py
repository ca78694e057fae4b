"""Histogram boosting against a plain loop over all splits, and its ways against each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import boosting as B
from vitalgrid.operators import models as MD
from vitalgrid.operators.metrics import auroc

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(7)
    n = 900
    x = np.column_stack([draw.normal(size=n), draw.integers(0, 6, n), np.round(draw.normal(size=n), 1)])
    y = (x[:, 0] + 0.5 * (x[:, 1] > 2) + 0.3 * x[:, 2] ** 2 + draw.normal(size=n) > 0.8).astype(int)
    w = np.where(y == 1, 2.0, 1.0)
    data = [(int(i), *map(float, x[i]), int(y[i]), float(w[i]), int(i % 3)) for i in range(n)]
    return spark.createDataFrame(data, "id long, a double, b double, c double, y int, w double, f int").cache(), x, y, w


def plain_trees(x, y, w, spec):
    """Trees by trying every split between two values of every leaf, best leaf first; returns the rows' scores."""
    p0 = (w * y).sum() / w.sum()
    score = np.full(len(y), np.log(p0 / (1 - p0)))
    for _ in range(spec.max_iter):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (p - y), w * p * (1 - p)

        def best(rows):
            found = None
            whole = g[rows].sum() ** 2 / (h[rows].sum() + spec.l2)
            for c in range(x.shape[1]):
                for v in np.unique(x[rows, c])[:-1]:
                    left = rows[x[rows, c] <= v]
                    right = rows[x[rows, c] > v]
                    if min(len(left), len(right)) < spec.min_leaf or min(h[left].sum(), h[right].sum()) < 1e-3:
                        continue
                    gain = (g[left].sum() ** 2 / (h[left].sum() + spec.l2)
                            + g[right].sum() ** 2 / (h[right].sum() + spec.l2) - whole)
                    if gain > 1e-12 and (found is None or gain > found[0] + 1e-12):
                        found = (gain, left, right)
            return found

        leaves = [(np.arange(len(y)), 0)]
        while len(leaves) < spec.leaves:
            options = [(b[0], k, b) for k, (r, d) in enumerate(leaves)
                       if (spec.max_depth is None or d < spec.max_depth) and (b := best(r))]
            if not options:
                break
            _, k, (_, left, right) = max(options, key=lambda o: o[0])
            depth = leaves.pop(k)[1]
            leaves += [(left, depth + 1), (right, depth + 1)]
        for r, _ in leaves:
            score[r] -= spec.step * g[r].sum() / (h[r].sum() + spec.l2)
    return score


@pytest.mark.parametrize("spec", [B.Spec(max_iter=3, leaves=6, min_leaf=20),
                                  B.Spec(max_iter=2, leaves=31, min_leaf=10, l2=1.0, step=0.3, max_depth=3)])
def test_equals_a_plain_loop(spark, rows, spec, monkeypatch):
    df, x, y, w = rows
    x = np.column_stack([np.round(x[:, 0], 1), x[:, 1], x[:, 2]])  # fewer values than bins
    df = df.withColumn("a", F.round("a", 1))
    want = 1 / (1 + np.exp(-plain_trees(x, y, w, spec)))
    (fitted,), _ = B.fit_many(df, COLS, "y", [spec], "w")
    got = [r[0] for r in MD.score(fitted.spark_model(spark), df, COLS).orderBy("id").select("risk_score").collect()]
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_blocks_and_many_models_equal_single_fits(spark, rows):
    df = rows[0]
    specs = [B.Spec(max_iter=4, left_out=0), B.Spec(max_iter=12, step=0.2, min_leaf=10, l2=0.1, left_out=1, max_depth=4),
             B.Spec(max_iter=3, columns=(0, 2)), B.Spec(max_iter=60, step=0.5, min_leaf=5, patience=3, seed=5)]
    one, held_one = B.fit_many(df, COLS, "y", specs, "w", fold="f")
    jobs, held_jobs = B.fit_many(df, COLS, "y", specs, "w", fold="f", block_rows=250)
    for a, b in zip(one, jobs, strict=True):
        assert [t.feature for t in a.trees] == [t.feature for t in b.trees]
        assert [t.bin for t in a.trees] == [t.bin for t in b.trees]
        for s, t in zip(a.trees, b.trees, strict=True):
            np.testing.assert_allclose(s.value, t.value, rtol=1e-8, atol=1e-12)
            assert sum(f < 0 for f in s.feature) <= 31
    for m, spec in enumerate(specs):
        (alone,), _ = B.fit_many(df, COLS, "y", [spec], "w", fold="f")
        assert [t.bin for t in alone.trees] == [t.bin for t in one[m].trees]
        x = sorted((r["label"], round(r["risk_score"], 9)) for r in held_one.filter(F.col("model") == m).collect())
        assert x == sorted((r["label"], round(r["risk_score"], 9)) for r in held_jobs.filter(F.col("model") == m).collect())
        assert len(x) == (0 if spec.left_out is None else 300)
    assert len(one[3].trees) < 60  # noise stops it
    model = one[1].spark_model(spark)
    held = MD.score(model, df.filter("f = 1"), COLS)
    assert sorted((r["y"], round(r["risk_score"], 9)) for r in held.collect()) == sorted(
        (r["label"], round(r["risk_score"], 9)) for r in held_one.filter("model = 1").collect())


def test_many_values_and_missing_cells(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 50 == 0, None).otherwise(F.sin("id")).alias("a"),
                                  F.cos(F.col("id") * 3).alias("b"))
    df = df.withColumn("y", (F.coalesce("a", F.lit(0.0)) * F.col("b") > 0.1).cast("int"))
    model = MD.fit_boosting(df, ["a", "b"], "y", max_iter=40)
    assert auroc(MD.score(model, df, ["a", "b"]), "risk_score", "y").first()[0] > 0.99
    assert abs(sum(model.featureImportances.toArray()) - 1) < 1e-9


def test_one_class_and_constant_features(spark):
    df = spark.range(100).select("id", F.lit(1.0).alias("a"), F.lit(0).alias("y"))
    model = MD.fit_boosting(df, ["a"], "y", max_iter=2)
    assert MD.score(model, df, ["a"]).agg(F.max("risk_score")).first()[0] < 1e-9


def test_search_applies_every_axis(spark, rows, monkeypatch):
    df = rows[0]
    monkeypatch.setitem(MD.GB_SPACE, "max_iter", [3, 5])
    best, table = MD.random_search(df, COLS, "y", kind="gb", n_iter=4, folds=3, seed=1, key="id")
    got = table.collect()
    assert len(got) == 4 and all(0.5 < r["cv_auroc"] <= 1 for r in got)
    assert set(MD.GB_SPACE) == {"max_iter", "max_depth", "learning_rate", "min_samples_leaf", "l2_regularization"}
    assert best.getNumTrees in (4, 6)


def test_seeds_draw_the_rows_held_back(spark, rows):
    got, _ = B.fit_many(rows[0], COLS, "y", [B.Spec(max_iter=30, patience=5, seed=s) for s in (1, 2, 1)], "w")
    one, two, again = ([t.bin for t in f.trees] for f in got)
    assert one == again != two
    assert B.enough(B.Spec(patience=2), [3, 2, 2, 2]) and not B.enough(B.Spec(patience=2), [3, 2, 2, 1.9])
    assert not B.enough(B.Spec(), [1, 2, 3, 4]) and not B.enough(B.Spec(patience=3), [1, 2, 3])
