"""Packed scores, packed training rows and samples per group give what rows one by one give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import grouped as GR
from vitalgrid.operators import metrics as M
from vitalgrid.operators import splits as SP


def cells(spark, n=4000):
    u = [F.conv(F.substring(F.md5(F.concat_ws(":", "id", F.lit(c))), 1, 6), 16, 10).cast("double") / 2 ** 24 for c in "abc"]
    df = spark.range(n).select("id", *[x.alias(c) for x, c in zip(u, "abc", strict=True)]).repartition(6)
    df = df.withColumns({c: F.when(F.col("id") % 3 == 0, F.lit(0.25)).otherwise(F.col(c)) for c in "abc"})  # level scores
    return df.withColumn("y", (F.col("a") + F.col("b") + (F.col("id") % 7) / 7 > 1.4).cast("int"))


@pytest.mark.parametrize("range_rows", [10_000, 300])
def test_packed_scores_have_the_same_metrics(spark, monkeypatch, range_rows):
    monkeypatch.setattr(GR, "BLOCK_ROWS", 500)
    df = cells(spark).unionByName(cells(spark, 5).withColumn("y", F.lit(None).cast("int")))
    models = {f"m{k}": GR.init_params(3, k) for k in range(3)}
    got = M.model_table(GR.pack_scores(df, list("abc"), models, 3, "y", range_rows), "model", "score", "y")
    want = M.model_table(GR.score_models(df, list("abc"), models, 3, keep=["y"]), "model", "score", "y")
    got, want = ({r["model"]: (r["auroc"], r["prauc"]) for r in x.collect()} for x in (got, want))
    assert set(got) == set(models)
    for m in models:
        assert np.allclose(got[m], want[m], rtol=0, atol=1e-12)


def test_missing_scores_raise(spark):
    df = cells(spark, 50).withColumn("a", F.when(F.col("id") > 5, F.col("a")))
    with pytest.raises(Exception, match="NULL in the scores of m"):
        GR.pack_scores(df, list("abc"), {"m": GR.init_params(3, 1)}, 3, "y").collect()


def test_one_class_has_no_auroc(spark):
    df = cells(spark, 50).withColumn("y", F.lit(1))
    got = M.model_table(GR.score_models(df, list("abc"), {"m": GR.init_params(3, 1)}, 3, packed_for="y"), "model", "score", "y")
    assert [tuple(r) for r in got.collect()] == [("m", None, 1.0)]


def test_blocks_hold_rows_of_equal_groups(spark, monkeypatch):
    monkeypatch.setattr(GR, "BLOCK_ROWS", 100)
    df = cells(spark, 1000).select(F.array(F.concat(F.lit("s"), F.col("id") % 2), F.lit("all")).alias("g"),
                                   F.array(*"abc").alias("x"), "y")
    blocks = GR.blocks_of(df, "g", "x", "y")
    assert blocks.agg(F.max(F.length("y"))).first()[0] <= 800
    params = {g: GR.init_params(3, k) for k, g in enumerate(("s0", "s1", "all"))}
    got = GR.gradient_of_blocks(blocks, params, 3)
    rows = df.collect()
    for g, theta in params.items():
        x, y = (np.array([r[c] for r in rows if g in r["g"]], float) for c in "xy")
        loss, grad = GR.loss_and_grad_sums(x, y, theta, 3)
        assert got[g][0] == len(y) and abs(got[g][1] - loss) < 1e-9 and np.allclose(got[g][2], grad, atol=1e-9)


def test_large_samples_per_group_cut_before_the_exchange(spark):
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        df = spark.range(6000).select(F.col("id"), F.when(F.col("id") % 50 == 0, None).otherwise(F.col("id") % 3).alias("g"))
        df = df.filter("g IS NULL OR g < 2 OR id < 100")
        got = SP.sample_n(df, "id", 700, seed=3, by="g")
        rows = df.withColumn("h", SP.stable_hash_key("id", 3)).filter("g IS NOT NULL").collect()
        want = {r["id"] for g in range(3) for r in sorted((r for r in rows if r["g"] == g), key=lambda r: r["h"])[:700]}
        assert sorted(r["id"] for r in got.collect()) == sorted(want)
        kept = SP._below_cut(df.withColumn("_h", SP.stable_hash_key("id", 3)), ["g"], 700).count()
        assert len(want) <= kept <= len(want) + 50
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
