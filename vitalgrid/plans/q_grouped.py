"""Grouped training queries (centralised / local-only / averaged MLP) and the
weighted parameter average, on the sustained-label feature table of P-raw."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.operators import grouped as GR
from vitalgrid.operators import metrics as M
from vitalgrid.operators import splits as SP
from vitalgrid.plans.q_models import COLS14, E, Y, train_test
from vitalgrid.plans.registry import query, rounded
from vitalgrid.session import materialize
from vitalgrid.sources import fixtures as X

# The grouped-training setup of the reference.
N_CLIENTS = 4
N_ROUNDS = 15
LOCAL_EPOCHS = 2
ROWS_PER_CLIENT = 60_000
SEEDS = [42, 123, 2024]
MISSING_DATA_FRACTIONS = [0.0, 0.1, 0.25, 0.5]


def experiment(spark, d):
    """Split by entity (fixed), standardise on train, per seed: entities ->
    clients, at most ROWS_PER_CLIENT rows per client, then train all setups
    and score every model on the test entities. Every query trains anew, so its
    result is that of the tables as they are and its time that of the whole job."""
    train, test = train_test(spark, d, sustained=True)
    train, test = SP.standardise(train, test, COLS14)
    train = materialize(train.select(E, "event_id", *COLS14, Y), "grouped-train")
    test = materialize(test.select(E, "event_id", *COLS14, Y), "grouped-test")
    parts = []
    for s in SEEDS:
        cl = SP.assign_clients(train, E, k=N_CLIENTS, seed=s)
        rows = train.join(cl, E, "inner")
        rows = SP.sample_n(rows, "event_id", ROWS_PER_CLIENT, seed=s, by="client")
        parts.append(rows.withColumn("seed", F.lit(s)))
    clients = reduce(DataFrame.unionByName, parts)
    res = GR.train_grouped(clients, COLS14, Y, SEEDS, rounds=N_ROUNDS, epochs=LOCAL_EPOCHS, n_clients=N_CLIENTS)
    models = dict(res["params"])
    for s in SEEDS:
        models[f"{s}|fedfinal|0"] = res["global"][s]
        for r, th in enumerate(res["history"][s]):
            models[f"{s}|round|{r + 1}"] = th
    scored = GR.score_models(test, COLS14, models, res["n_in"], packed_for=Y)
    table = M.model_table(scored, "model", "score", Y)
    table = materialize(table, "grouped-metrics")
    parsed = table.select(F.split("model", r"\|").alias("p"), "auroc", "prauc").select(
        F.col("p")[0].cast("int").alias("seed"), F.col("p")[1].alias("kind"), F.col("p")[2].cast("int").alias("idx"),
        "auroc", "prauc")
    return res, test, parsed


def per_seed(parsed: DataFrame) -> DataFrame:
    """Rows (seed, setup, auroc, prauc): local-only is the mean over clients."""
    setups = {"central": "centralized", "local": "local_only", "fedfinal": "federated"}
    sel = parsed.filter(F.col("kind").isin(list(setups)))
    name = F.create_map(*[x for k, v in setups.items() for x in (F.lit(k), F.lit(v))])[F.col("kind")]
    return sel.groupBy("seed", name.alias("setup")).agg(F.avg("auroc").alias("auroc"), F.avg("prauc").alias("prauc"))


@query("train_grouped")
def q_train_grouped(spark, d):
    """Centralised, local-only (mean over clients) and averaged training:
    test AUROC and PR-AUC per seed and setup."""
    _, _, parsed = experiment(spark, d)
    return rounded(per_seed(parsed))


@query("grouped_summary")
def q_grouped_summary(spark, d):
    """Mean and population std over seeds per setup."""
    _, _, parsed = experiment(spark, d)
    return rounded(M.seed_summary(per_seed(parsed), "setup", ["auroc", "prauc"]))


@query("round_curve")
def q_round_curve(spark, d):
    """Averaged model after each round: mean and population std of test AUROC over seeds."""
    _, _, parsed = experiment(spark, d)
    r = parsed.filter(F.col("kind") == "round").withColumnRenamed("idx", "round")
    return rounded(r.groupBy("round").agg(F.avg("auroc").alias("auroc_mean"), F.stddev_pop("auroc").alias("auroc_std"),
                                          F.avg("prauc").alias("prauc_mean"), F.stddev_pop("prauc").alias("prauc_std")))


@query("missing_data")
def q_missing_data(spark, d):
    """Best averaged model (highest test AUROC over seeds) rescored with a
    fraction of the standardised test cells set to 0."""
    res, test, parsed = experiment(spark, d)
    best = parsed.filter(F.col("kind") == "fedfinal").orderBy(F.desc("auroc"), "seed").first()["seed"]
    theta = res["global"][best]
    variants = []
    for frac in MISSING_DATA_FRACTIONS:
        masked = SP.mask_cells(test, COLS14, frac, seed=42, key="event_id") if frac > 0 else test
        variants.append(masked.withColumn("missing_fraction", F.lit(frac)))
    allv = reduce(DataFrame.unionByName, variants)
    scored = GR.score_models(allv, COLS14, {"fed": theta}, res["n_in"], keep=["missing_fraction", Y])
    return rounded(M.model_table(scored, "missing_fraction", "score", Y))


@query("average_parameters", X.Y_VEC_SQL + """,
c AS (SELECT label, count(*) AS n FROM y_vec GROUP BY label),
l AS (SELECT y.vec_id, c.n, unnest(y.embedding) AS w, generate_subscripts(y.embedding, 1) AS pos
      FROM y_vec y JOIN c USING (label)),
a AS (SELECT pos, sum(w * n) / sum(n) AS avg_w FROM l GROUP BY pos)
SELECT list_transform(list(avg_w ORDER BY pos), lambda x: round(x, 6)) AS embedding FROM a""")
def q_average_parameters(spark, d):
    """Sample-weighted mean of vectors: each embedding weighted by the size of its label group."""
    v = X.y_vec(spark, d)
    n = v.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    out = GR.average_parameters(v.join(n, "label"), "embedding", "n")
    return out.select(F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))
