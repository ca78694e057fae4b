"""Inputs outside the oracle fixtures: spikes, NULLs, reordered files, large samples."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import filters as FL
from vitalgrid.operators import grid as G
from vitalgrid.operators import metrics as M
from vitalgrid.operators import models as MD
from vitalgrid.operators import splits as SP
from vitalgrid.operators.features import impute_entity_mean
from vitalgrid.operators.sequence import flag_episodes, rolling_mean
from vitalgrid.session import materialize, release
from vitalgrid.sources import io as IO


@pytest.mark.parametrize("values", [[1e17, 1.0, 1.0, 1.0, 1.0], [math.nan, 1.0, 2.0, 4.0, 8.0],
                                    [math.inf, 1.0, None, 4.0, 8.0, 16.0]])
@pytest.mark.parametrize("rows", [1, 2, 3])
def test_rolling_mean_after_spike_nan_and_inf(spark, values, rows):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "e int, i int, x double").selectExpr(
        "e", "timestamp_seconds(i) t", "x")
    got = [r["x_trend"] for r in rolling_mean(df, "e", ["t"], ["x"], rows=rows).orderBy("t").collect()]
    usable = pd.Series([v if v is not None and math.isfinite(v) else math.nan for v in values])
    want = [usable[max(0, i - rows + 1):i + 1].mean() for i in range(len(values))]
    assert got == [None if math.isnan(w) else w for w in want]


def test_read_panel_binds_by_name(spark, tmp_path):
    (tmp_path / "p.csv").write_text("user_id,received_date,extra,b,a\n1,2024-01-01 00:00:00,x,61,97\n")
    schema = IO.panel_schema(signals=["a", "b"])
    row = IO.read_panel(spark, str(tmp_path / "p.csv"), schema=schema).first()
    assert (row["a"], row["b"]) == (97.0, 61.0)
    with pytest.raises(ValueError, match="c"):
        IO.read_panel(spark, str(tmp_path / "p.csv"), schema=IO.panel_schema(signals=["a", "c"]))


def test_unreadable_alert_log_raises(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "part.parquet").write_text("not a log")
    new = spark.sql("SELECT 1L user_id, timestamp'2024-01-01' alert_time, 1D risk_score, 1D uncertainty")
    with pytest.raises(Exception):  # noqa: B017
        IO.append_alerts(new, str(tmp_path / "log"))
    assert len(list((tmp_path / "log").iterdir())) == 1


def test_null_labels_and_scores_do_not_vanish(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 2).alias("y"))
    train, test = SP.split_stratified(df, "y", "id", 0.25)
    assert train.count() + test.count() == 100 and test.filter("y is null").count() == 3
    with pytest.raises(Exception, match="NULL in score"):
        M.auroc(df.select(F.col("y").alias("s"), F.lit(1).alias("l")), "s", "l").collect()


def test_narrow_types_widens_for_large_ids(spark):
    df = spark.createDataFrame([(1, 40_000, 2 ** 40)], "a long, b long, c long")
    out = FL.narrow_types(df, short_cols=["a", "b", "c"])
    assert [f.dataType.simpleString() for f in out.schema] == ["smallint", "int", "bigint"]
    assert tuple(out.first()) == (1, 40_000, 2 ** 40)


def test_large_sample_is_exact_without_one_task(spark, monkeypatch):
    df = spark.range(30_000)
    want = {r[0] for r in df.withColumn("h", SP.stable_hash_key("id", 5)).orderBy("h").limit(900).collect()}
    small = SP.sample_n(df, "id", 900, seed=5)
    monkeypatch.setattr(SP, "CUT_ROWS", 0)
    large = SP.sample_n(df, "id", 900, seed=5)
    assert {r[0] for r in small.collect()} == {r[0] for r in large.collect()} == want
    assert "TakeOrderedAndProject" not in large._jdf.queryExecution().executedPlan().toString()


def test_search_draws_differ_and_are_applied():
    draws = MD.sample_space(MD.RF_SPACE, 15, 42)
    assert len({str(x) for x in draws}) == 15
    assert set(MD.RF_SPACE) == {"n_estimators", "max_depth", "min_samples_leaf", "max_features"}
    assert set(MD.GB_SPACE) == {"max_iter", "max_depth", "learning_rate", "min_samples_leaf", "l2_regularization"}


def test_search_table_holds_what_was_fitted(spark, monkeypatch):
    monkeypatch.setattr(MD, "RF_SPACE", {"n_estimators": [2, 3], "max_depth": [2, None], "min_samples_leaf": [1, 4],
                                         "max_features": ["sqrt", None]})
    df = spark.range(300).selectExpr("id", "double(id % 7) a", "double(id % 5) b", "int(id % 7 > 3) y")
    best, table = MD.random_search(df, ["a", "b"], "y", n_iter=3, folds=2, key="id", parallelism=2)
    rows = table.collect()
    assert len(rows) == 3 and rows[0]["cv_auroc"] == max(r["cv_auroc"] for r in rows)
    won = MD.sample_space(MD.RF_SPACE, 3, 42)[rows[0]["draw"]]
    assert str(won) == rows[0]["params"]
    assert best.getNumTrees == won["n_estimators"] and best.getOrDefault("maxDepth") == (won["max_depth"] or 30)
    assert best.getOrDefault("minInstancesPerNode") == won["min_samples_leaf"]


def test_one_pass_metrics_equal_the_single_ones(spark):
    df = spark.range(200).selectExpr("id % 3 m", "double(hash(id) % 17) s", "int(abs(hash(id, 1)) % 2) y")
    both = {r["m"]: (r["auroc"], r["prauc"]) for r in M.model_table(df, "m", "s", "y").collect()}
    one = {r["m"]: r["auroc"] for r in M.auroc(df, "s", "y", by="m").collect()}
    two = {r["m"]: r["average_precision"] for r in M.average_precision(df, "s", "y", by="m").collect()}
    assert set(both) == {0, 1, 2}
    for m, (a, p) in both.items():
        assert a == pytest.approx(one[m], abs=1e-12) and p == pytest.approx(two[m], abs=1e-12)


def test_long_gap_by_pieces_and_order_needed_for_duplicates(spark, monkeypatch):
    monkeypatch.setattr(G, "GAP_POINTS", 7)
    df = spark.sql("SELECT 1 e, timestamp_seconds(60 * m) t, double(m) x FROM VALUES (0), (1), (30), (44) v(m)")
    rows = G.reindex_to_grid(df, "e", "t").orderBy("t").collect()
    assert [r["x"] for r in rows] == [float(m) if m in (0, 1, 30, 44) else None for m in range(45)]
    assert [r["was_present"] for r in rows] == [r["x"] is not None for r in rows]
    with pytest.raises(ValueError, match="order"):
        G.reindex_to_grid(df, "e", "t", on_duplicate="last")


def test_release_deletes_what_was_materialised(spark):
    t = materialize(spark.range(5), "gone")
    path = t.inputFiles()[0]
    assert release(spark) >= 1
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def test_episodes_of_a_hot_day_in_small_chunks(spark):
    minutes = [0, 1, 2, 2, 3, 10, 11, 30, 31, 32, 33, 34]
    df = spark.createDataFrame([(1, 60 * m) for m in minutes], "e int, s long").selectExpr(
        "e", "timestamp_seconds(s) t", "true f")
    for chunk_rows in (1, 2, 5, 1000):
        got = flag_episodes(df, "e", "t", "f", chunk_rows=chunk_rows).orderBy("episode_start").collect()
        assert [r["n_rows"] for r in got] == [5, 2, 5]


def test_missing_raw_cells_get_the_entity_mean(spark):
    df = spark.createDataFrame([(1, 2.0, None), (1, None, None), (1, 4.0, None), (2, None, 7.0)],
                               "e int, a double, b double")
    rows = {(r["e"], r["a"], r["b"]) for r in impute_entity_mean(df, "e", ["a", "b"]).collect()}
    assert rows == {(1, 2.0, None), (1, 3.0, None), (1, 4.0, None), (2, None, 7.0)}


def test_folds_by_entity_share_none(spark):
    df = spark.range(400).selectExpr("id", "id % 23 AS e").select("e", MD.fold_id("e", 3, 42).alias("f"))
    assert df.distinct().count() == 23 and df.select("f").distinct().count() == 3
