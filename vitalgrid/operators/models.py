"""Models on Spark ML: rule baseline, logistic regression, forests, boosting,
scores, per-tree spread, importances, ablation, seed runs and random search.

Training runs as Spark jobs on executors (tree aggregation, L-BFGS, histogram
sums); only the model itself (coefficients, tree nodes: bounded by the
parameters) lives on the driver. Scores and the per-tree spread come from
Spark ML's tree walk in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.operators.baselines import any_exceeds, zscore
from vitalgrid.operators import forests
from vitalgrid.operators.boosting import BLOCK_ROWS, Spec, fit_many
from vitalgrid.operators.features import fill_features
from vitalgrid.operators.metrics import auroc, ranking_metrics
from vitalgrid.functions.scalar import stable_uniform
from vitalgrid.operators.trees import squared
from vitalgrid.session import materialize

FEATURES = "features"
WEIGHT = "weight"
# Rows from which boosting stops early, and trees it waits for an improvement.
STOP_ROWS, PATIENCE = 10_000, 10


def threshold_rule(df: DataFrame, entity: str, signals: Sequence[str], threshold: float = 2.0,
                   out: str = "pred") -> DataFrame:
    """Rule baseline: 1 when any personal z-score exceeds ``threshold`` in absolute value."""
    z = zscore(df, entity, signals)
    z = any_exceeds(z, [f"{s}_zscore" for s in signals], threshold, out="_flag")
    return z.withColumn(out, F.col("_flag").cast("int")).drop("_flag")


def assemble(df: DataFrame, cols: Sequence[str], out: str = FEATURES) -> DataFrame:
    """Missing cells -> 0, then one ``VectorAssembler`` column."""
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(fill_features(df, cols))


def balanced_weights(df: DataFrame, label: str, out: str = WEIGHT) -> DataFrame:
    """``n / (2 * n_y)`` per row (sklearn's ``class_weight='balanced'``, two classes)."""
    from vitalgrid.operators.splits import class_weights
    return class_weights(df, label, out)


def fit_logistic(train: DataFrame, cols: Sequence[str], label: str, balanced: bool = True,
                 max_iter: int = 1000, c: float = 1.0):
    """L2 logistic regression with sklearn's objective: ``0.5|w|^2 + C sum w_i loss_i``
    is ``regParam = 1 / (C * sum w)`` in Spark's mean-loss form, no standardisation."""
    d = assemble(train, cols)
    if balanced:
        d = balanced_weights(d, label)
    else:
        d = d.withColumn(WEIGHT, F.lit(1.0))
    total_w = d.agg(F.sum(WEIGHT)).first()[0]
    lr = LogisticRegression(featuresCol=FEATURES, labelCol=label, weightCol=WEIGHT, maxIter=max_iter,
                            regParam=1.0 / (c * total_w), elasticNetParam=0.0, standardization=False)
    return lr.fit(d)


def forest(num_trees: int = 100, max_depth: int = 14, seed: int = 42, label: str = "label",
           min_instances: int = 1, feature_subset: str = "sqrt", max_bins: int = 64) -> RandomForestClassifier:
    """A forest configured like the reference (bootstrap, sqrt features)."""
    # deep trees: cache each row's node id instead of shipping the trees every
    # level, and let one pass aggregate more nodes (fewer passes per level)
    return RandomForestClassifier(featuresCol=FEATURES, labelCol=label, weightCol=WEIGHT, numTrees=num_trees,
                                  maxDepth=min(max_depth, 30), seed=seed, minInstancesPerNode=min_instances,
                                  featureSubsetStrategy=feature_subset, maxBins=max_bins, bootstrap=True,
                                  cacheNodeIds=True, maxMemoryInMB=1024, checkpointInterval=10)


def fit_forest(train: DataFrame, cols: Sequence[str], label: str, num_trees: int = 100, max_depth: int = 14,
               seed: int = 42, balanced: bool = True, **kw):
    d = assemble(train, cols)
    d = balanced_weights(d, label) if balanced else d.withColumn(WEIGHT, F.lit(1.0))
    return forest(num_trees, max_depth, seed, label, **kw).fit(d)


def grow_forest(train: DataFrame, cols: Sequence[str], label: str, num_trees: int = 100, max_depth: int = 14,
                seed: int = 42, balanced: bool = True):
    """``fit_forest`` with its trees grown in tasks (``forests``) where the rows fit one block."""
    if train.count() > BLOCK_ROWS:
        return fit_forest(train, cols, label, num_trees, max_depth, seed, balanced)
    table = forests.Table(boosting_rows(train, label, balanced), cols, label, WEIGHT)
    return table.fit([forests.Spec(num_trees, min(max_depth, 30), seed=seed)])[0]


def boosting_rows(train: DataFrame, label: str, balanced: bool = True) -> DataFrame:
    return balanced_weights(train, label) if balanced else train.withColumn(WEIGHT, F.lit(1.0))


def fit_boosting(train: DataFrame, cols: Sequence[str], label: str, max_iter: int = 150, step: float = 0.1,
                 max_depth: int | None = None, seed: int = 42, balanced: bool = True, min_leaf: int = 20,
                 l2: float = 0.0, leaves: int = 31) -> GBTClassificationModel:
    """Histogram gradient boosting (``boosting.fit_many``): logistic loss, balanced
    sample weights, trees grown best-first to 31 leaves. On more than ``STOP_ROWS``
    rows a tenth, drawn by ``seed``, is held back and growth stops when its loss
    has not improved for ``PATIENCE`` trees; below, nothing is drawn at random."""
    spec = Spec(max_iter, step, max_depth, min_leaf, l2, leaves, patience=patience(train), seed=seed)
    (fitted,), _ = fit_many(boosting_rows(train, label, balanced), cols, label, [spec], WEIGHT)
    return fitted.spark_model(train.sparkSession)


def patience(train: DataFrame, share: float = 1.0) -> int:
    """Trees without improvement before growth stops: 0 (never) for a fit on few rows."""
    return PATIENCE if train.count() * share > STOP_ROWS else 0


def _p1():
    """Probability of class 1 (0 when the model saw only class 0)."""
    return F.coalesce(F.get(vector_to_array(F.col("probability")), 1), F.lit(0.0))


def score(model, df: DataFrame, cols: Sequence[str], out: str = "risk_score") -> DataFrame:
    """``out`` = probability of class 1; input columns kept."""
    p = model.transform(assemble(df, cols))
    return p.withColumn(out, _p1()).drop(
        FEATURES, "rawPrediction", "probability", "prediction")


# ------------------------------------------------------------------ per-tree spread
def tree_uncertainty(model, df: DataFrame, cols: Sequence[str], out_score: str = "risk_score",
                     out_unc: str = "uncertainty") -> DataFrame:
    """Forest probability and the population std of the per-tree
    probabilities: ``sqrt(max(E[p^2] - E[p]^2, 0))``. The mean of the squares is
    the prediction of the same trees with squared leaf values
    (``trees.squared``), so both come from Spark ML's tree walk: no Python
    worker, no leaf table on the driver."""
    squares = squared(model, df.sparkSession).copy().setFeaturesCol(FEATURES).setPredictionCol("_sq")
    m = model.copy()
    m.setFeaturesCol(FEATURES).setProbabilityCol("_prob").setRawPredictionCol("").setPredictionCol("")
    scored = squares.transform(m.transform(assemble(df, cols)))
    p = F.coalesce(F.get(vector_to_array(F.col("_prob")), F.lit(1)), F.lit(0.0))
    return (scored.withColumn(out_score, p)
                  .withColumn(out_unc, F.sqrt(F.greatest(F.col("_sq") - F.col(out_score) * F.col(out_score), F.lit(0.0))))
                  .drop(FEATURES, "_prob", "_sq"))


def signal_importance(model, cols: Sequence[str], signals: Sequence[str],
                      exclude: Sequence[str] = ()) -> dict[str, float]:
    """Raw + z + trend importance summed per signal (``exclude`` left out)."""
    imp = dict(zip(cols, model.featureImportances.toArray().tolist()))
    out = {}
    for s in signals:
        if s in exclude:
            continue
        out[s] = sum(imp.get(c, 0.0) for c in (s, f"{s}_zscore", f"{s}_zscore_trend"))
    return out


# ------------------------------------------------------------------ experiments
def evaluate(pred: DataFrame, label: str, name: str, score_col: str = "risk_score") -> DataFrame:
    """One row ``model, auroc, prauc`` (exact metrics). Scores are written once,
    so the model runs once over ``pred``."""
    scored = materialize(pred.select(score_col, label), "scored")
    return ranking_metrics(scored, score_col, label).select(F.lit(name).alias("model"), "auroc", "prauc")


def auroc_value(pred: DataFrame, label: str, score_col: str = "risk_score") -> float:
    return float(auroc(pred, score_col, label).first()[0])


def ablation(train: DataFrame, test: DataFrame, signals: Sequence[str], cols: Sequence[str], label: str,
             fit: Callable, derived: Callable[[str], Sequence[str]], apply: Callable = score) -> DataFrame:
    """Refit without each signal and its derived columns; AUROC and the drop
    against the full model, most important first (largest drop).
    ``apply(model, rows, columns)`` adds ``risk_score``."""
    spark = train.sparkSession
    base = auroc_value(apply(fit(train, cols, label), test, cols), label)
    rows = []
    for s in signals:
        drop = set(derived(s))
        reduced = [c for c in cols if c not in drop]
        a = auroc_value(apply(fit(train, reduced, label), test, reduced), label)
        rows.append((s, a, base - a))
    df = spark.createDataFrame(rows, "signal string, auroc double, auroc_drop double")
    return df.withColumn("baseline_auroc", F.lit(base)).orderBy(F.desc("auroc_drop"), "signal")


def ablation_boosting(train: DataFrame, test: DataFrame, signals: Sequence[str], cols: Sequence[str], label: str,
                      derived: Callable[[str], Sequence[str]], max_iter: int = 150) -> DataFrame:
    """``ablation`` with boosting: the full model and the one without each signal
    are fitted side by side on one binned table."""
    cols, groups = list(cols), [None, *signals]
    kept = [[c for c in cols if s is None or c not in set(derived(s))] for s in groups]
    wait = patience(train)
    specs = [Spec(max_iter, columns=tuple(cols.index(c) for c in k), patience=wait) for k in kept]
    fitted, _ = fit_many(boosting_rows(train, label), cols, label, specs, WEIGHT)
    spark = train.sparkSession
    got = [auroc_value(score(f.spark_model(spark), test, k), label) for f, k in zip(fitted, kept, strict=True)]
    df = spark.createDataFrame([(s, a, got[0] - a) for s, a in zip(signals, got[1:], strict=True)],
                               "signal string, auroc double, auroc_drop double")
    return df.withColumn("baseline_auroc", F.lit(got[0])).orderBy(F.desc("auroc_drop"), "signal")


def rank_ablation(table: DataFrame) -> DataFrame:
    """``rank`` by AUROC drop (1 = most important, ties by name) and flags for
    the most and least important signal, for a table with one row per signal."""
    # one row per signal: a global window is fine here
    w = Window.orderBy(F.desc("auroc_drop"), "signal")
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return (table.withColumn("rank", F.row_number().over(w)).withColumn("most_important", F.col("rank") == 1)
                 .withColumn("least_important", F.col("rank") == n))


def seed_robustness(train: DataFrame, test: DataFrame, cols: Sequence[str], label: str,
                    fit: Callable, seeds: Sequence[int], return_best: bool = False):
    """One row per seed: AUROC and PR-AUC of the model fitted with that seed.
    ``return_best``: also return the fitted model of the best test AUROC."""
    parts, best, best_auc = [], None, -1.0
    for s in seeds:
        model = fit(train, cols, label, seed=s)
        row = evaluate(score(model, test, cols), label, "seed").withColumn("seed", F.lit(s))
        if return_best:
            row = materialize(row, "seed-run")
            auc = row.first()["auroc"]
            if auc is not None and auc > best_auc:
                best, best_auc = model, auc
        parts.append(row)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.drop("model")
    return (out, best) if return_best else out


# The two search spaces of the reference, in its terms, mapped to parameters below (no depth limit of a
# forest -> Spark's maximum of 30). The one axis that Spark's forests do not have (split size) is left out, so every
# value drawn is applied.
RF_SPACE = {
    "n_estimators": [50, 100, 150, 200],
    "max_depth": [8, 10, 14, 18, None],
    "min_samples_leaf": [1, 2, 4],
    "max_features": ["sqrt", "log2", None],
}
GB_SPACE = {
    "max_iter": [50, 100, 150],
    "max_depth": [None, 6, 10, 14],
    "learning_rate": [0.03, 0.05, 0.1, 0.2],
    "min_samples_leaf": [10, 20, 40],
    "l2_regularization": [0.0, 0.1, 1.0],
}


def sample_space(space: Mapping[str, list], n: int, seed: int) -> list[dict]:
    """``n`` different draws from a discrete space (seeded, without replacement)."""
    sizes = [len(v) for v in space.values()]
    cells = np.random.RandomState(seed).permutation(int(np.prod(sizes)))[:n]
    return [{k: v[i] for (k, v), i in zip(space.items(), at, strict=True)}
            for at in (np.unravel_index(int(c), sizes) for c in cells)]


def _rf_params(est: RandomForestClassifier, draw: dict) -> dict:
    feat = {"sqrt": "sqrt", "log2": "log2", None: "all"}[draw["max_features"]]
    return {est.numTrees: int(draw["n_estimators"]), est.maxDepth: 30 if draw["max_depth"] is None
            else int(draw["max_depth"]), est.minInstancesPerNode: int(draw["min_samples_leaf"]),
            est.featureSubsetStrategy: feat}


def _rf_spec(draw: dict, left_out: int | None, seed: int) -> forests.Spec:
    return forests.Spec(int(draw["n_estimators"]), 30 if draw["max_depth"] is None else int(draw["max_depth"]),
                        int(draw["min_samples_leaf"]), draw["max_features"] or "all", left_out, seed)


def _gb_spec(draw: dict, left_out: int | None, wait: int, seed: int) -> Spec:
    return Spec(int(draw["max_iter"]), float(draw["learning_rate"]), draw["max_depth"], int(draw["min_samples_leaf"]),
                float(draw["l2_regularization"]), left_out=left_out, patience=wait, seed=seed)


def fold_id(key: str, folds: int, seed: int) -> Column:
    """Fold 0 .. ``folds`` - 1 of a row, from the seeded hash of ``key``: a row
    key for folds of rows, the entity for folds that share no entity."""
    return F.floor(stable_uniform(key, F.lit("fold"), seed) * folds).cast("int")


def random_search(train: DataFrame, cols: Sequence[str], label: str, kind: str = "rf", n_iter: int = 15,
                  folds: int = 3, seed: int = 42, fold_by: str = "row", key: str | None = None,
                  entity: str | None = None, parallelism: int = 8):
    """Random search with k-fold cross-validation on AUROC (the exact one of
    ``metrics``, per draw and fold, then their mean). Folds come from the seeded
    hash of ``key`` (``fold_by='row'``) or of ``entity`` (``'entity'``: no entity
    in two folds). Boosting fits all draws and folds side by side on one binned
    table (``boosting.fit_many``), and so do forests on rows that fit one block
    (``forests``); on more rows ``parallelism`` forests run side by side, each as
    Spark ML's jobs on the assembled rows, which are written once.
    Returns (best model refitted on all rows, table of draws with their mean CV
    AUROC, best first)."""
    fold = fold_id(key if fold_by == "row" else entity, folds, seed)
    tasks = [(i, f) for i in range(n_iter) for f in range(folds)]
    grown = kind == "rf" and train.count() <= BLOCK_ROWS
    if grown:
        draws = sample_space(RF_SPACE, n_iter, seed)
        d = forests.Table(boosting_rows(train, label).withColumn("_fold", fold), cols, label, WEIGHT, fold="_fold")
        held = d.held_scores([_rf_spec(draws[i], f, seed) for i, f in tasks])
    elif kind == "rf":
        draws = sample_space(RF_SPACE, n_iter, seed)
        d = balanced_weights(assemble(train, cols), label).withColumn("_fold", fold)
        d = materialize(d.select(FEATURES, label, WEIGHT, "_fold"), "search")
        est = forest(seed=seed, label=label)

        def run(task: tuple[int, int]) -> DataFrame:
            i, f = task
            model = est.copy(_rf_params(est, draws[i])).fit(d.filter(F.col("_fold") != f))
            told = model.transform(d.filter(F.col("_fold") == f))
            return materialize(told.select(F.lit(i * folds + f).alias("model"), F.col(label).cast("int").alias("label"),
                                           _p1().alias("risk_score")), "search-fold")

        with ThreadPoolExecutor(parallelism) as pool:
            held = reduce(DataFrame.unionByName, pool.map(run, tasks))
    else:
        draws = sample_space(GB_SPACE, n_iter, seed)
        d = boosting_rows(train, label).withColumn("_fold", fold)
        wait = patience(train, (folds - 1) / folds)
        _, held = fit_many(d, cols, label, [_gb_spec(draws[i], f, wait, seed) for i, f in tasks], WEIGHT, fold="_fold")
    got = {r["model"]: r["auroc"] for r in auroc(materialize(held, "search-scores"), "risk_score", "label", by="model").collect()}
    # a fold without both classes has no AUROC and does not count
    mean = [float(np.mean(x)) if (x := [a for f in range(folds) if (a := got.get(i * folds + f)) is not None]) else 0.0
            for i in range(len(draws))]
    best = int(np.argmax(mean))
    rows = sorted(((i, str(draws[i]), m) for i, m in enumerate(mean)), key=lambda r: (-r[2], r[0]))
    table = train.sparkSession.createDataFrame(rows, "draw int, params string, cv_auroc double")
    if grown:
        return d.fit([_rf_spec(draws[best], None, seed)])[0], table
    if kind == "rf":
        return est.copy(_rf_params(est, draws[best])).fit(d), table
    (fitted,), _ = fit_many(d, cols, label, [_gb_spec(draws[best], None, patience(train), seed)], WEIGHT)
    return fitted.spark_model(train.sparkSession), table
