"""The model comparison reads a split that was written once, with all its rows."""

import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import models as MD
from vitalgrid.plans import q_models as Q


class Seen(Exception):
    pass


def test_models_read_a_split_written_once(spark, monkeypatch):
    feats = spark.range(400).select(
        (F.col("id") % 20).alias(Q.E), F.col("id").alias("event_id"), (F.col("id") % 2).cast("int").alias(Q.Y),
        *[F.when(F.col("id") % 7 > 0, (F.col("id") % 11).cast("double")).alias(c) for c in Q.COLS21])
    seen = {}

    def fit(train, *_):
        seen["train"] = train
        raise Seen

    monkeypatch.setattr(Q, "labelled", lambda *_: feats)
    monkeypatch.setattr(MD, "evaluate", lambda pred, *_: seen.setdefault("test", pred))
    monkeypatch.setattr(MD, "fit_logistic", fit)
    with pytest.raises(Seen):
        Q.q_baselines(spark, "")
    for part in seen.values():
        assert "Join" not in part._jdf.queryExecution().optimizedPlan().toString()
    assert {k: v.count() for k, v in seen.items()} == {"train": 300, "test": 100}
