"""The model comparison fits every model on all train rows, however many there are."""

import numpy as np
from pyspark.sql import functions as F

from vitalgrid.operators import boosting as B
from vitalgrid.operators import isolation
from vitalgrid.operators import models as MD
from vitalgrid.plans import q_models as Q


def test_models_are_fitted_on_all_train_rows(spark, monkeypatch):
    n = 420_000  # of which 315,000 train rows, more than the sample that other queries take
    feats = spark.range(n).select(
        (F.col("id") % 20).alias(Q.E), F.col("id").alias("event_id"), (F.col("id") % 2).cast("int").alias(Q.Y),
        *[(F.col("id") % 11).cast("double").alias(c) for c in Q.COLS21])
    seen = {}

    def fit(name):
        def run(train, *_, **how):
            seen.setdefault(name, []).append(train.count())
        return run

    monkeypatch.setattr(Q, "labelled", lambda *_: feats)
    for name in ("fit_logistic", "fit_forest", "fit_boosting"):
        monkeypatch.setattr(MD, name, fit(name))
    monkeypatch.setattr(isolation, "fit_isolation_forest", fit("fit_isolation_forest"))
    monkeypatch.setattr(isolation, "score_isolation_forest", lambda _, rows, *a, **k: rows)
    monkeypatch.setattr(MD, "score", lambda _, rows, *a: rows)
    monkeypatch.setattr(MD, "evaluate", lambda rows, y, name: rows.limit(1).select(F.lit(name).alias("model")))
    assert Q.q_baselines(spark, "").count() == 6
    whole = n * 3 // 4
    assert seen == {"fit_logistic": [whole], "fit_forest": [whole, whole], "fit_boosting": [whole],
                    "fit_isolation_forest": [whole]}


def test_boosting_in_jobs_keeps_one_table_of_scores(spark, monkeypatch):
    """Scores are written after every tree in place of the ones before; the trees are those of one block."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 2)).round(2)
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=900) > 0).astype(int)
    train = spark.createDataFrame([(*map(float, a), int(b), 1.0) for a, b in zip(x, y, strict=True)],
                                  "a double, b double, y int, w double")
    gone = []
    monkeypatch.setattr(B, "discard", lambda frame, discard=B.discard: (gone.append(frame.inputFiles()[0]), discard(frame)))
    spec = B.Spec(3, min_leaf=10, leaves=4)
    (jobs,), _ = B.fit_many(train, ["a", "b"], "y", [spec], "w", block_rows=250)
    assert len(set(gone)) == 3
    monkeypatch.setattr(B, "FEW", 0)
    (exchanged,), _ = B.fit_many(train, ["a", "b"], "y", [spec], "w", block_rows=250)
    (block,), _ = B.fit_many(train, ["a", "b"], "y", [spec], "w")
    for one, two in ((jobs, block), (exchanged, block)):
        assert len(one.trees) == 3
        for s, t in zip(one.trees, two.trees, strict=True):
            assert (s.feature, s.bin, s.left) == (t.feature, t.bin, t.left)
            np.testing.assert_allclose(s.value, t.value, rtol=1e-8, atol=1e-12)
