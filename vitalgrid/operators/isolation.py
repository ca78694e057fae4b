"""Isolation forest as Spark jobs.

Fit: every tree ``t`` gets ``sample_size`` rows drawn without replacement by
the seeded hash ``u(key, t)``. Rows are candidates for tree ``t`` with
probability ``rate`` (= 4 x sample_size / n, a Bernoulli sample with four-fold
headroom), drawn in two steps so that only about ``n_trees x rate x n`` rows
ever hash per tree; each tree keeps the ``sample_size`` candidates with the
smallest hash (``row_number`` with Spark's partial WindowGroupLimit) — a
uniform sample without replacement, since every row is a candidate of every
tree with the same probability. Each tree is grown in its own group by ``applyInPandas`` (a small
NumPy helper on at most ``sample_size`` rows); the node tables (bounded by
``n_trees x (2 x sample_size - 1)``) come back to the driver and are broadcast.

Score: an Arrow ``pandas_udf`` walks all trees for a batch of rows at once and
returns ``2 ** (-E[h(x)] / c(sample_size))`` — higher means more isolated
(the negated ``score_samples`` of the usual definition).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.functions.scalar import stable_uniform

EULER = 0.5772156649015329
NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("size", T.IntegerType()), T.StructField("depth", T.IntegerType()),
])


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful search in a binary tree of n points."""
    if n > 2:
        return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n
    return 1.0 if n == 2 else 0.0


def grow_tree(x: np.ndarray, tree: int, max_depth: int, seed: int) -> list[tuple]:
    """One isolation tree on ``x`` (rows x features): random feature, uniform
    threshold between the node's min and max; constant features are skipped."""
    rng = np.random.default_rng([seed, tree])
    nodes: list[tuple] = []

    def build(idx: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append(None)
        sub = x[idx]
        ok = np.flatnonzero(sub.max(axis=0) > sub.min(axis=0)) if len(idx) > 1 else np.array([], dtype=int)
        if depth >= max_depth or ok.size == 0:
            nodes[me] = (tree, me, -1, 0.0, -1, -1, int(len(idx)), depth)
            return me
        f = int(rng.choice(ok))
        lo, hi = float(sub[:, f].min()), float(sub[:, f].max())
        thr = float(rng.uniform(lo, hi))
        go_left = sub[:, f] <= thr
        left = build(idx[go_left], depth + 1)
        right = build(idx[~go_left], depth + 1)
        nodes[me] = (tree, me, f, thr, left, right, int(len(idx)), depth)
        return me

    build(np.arange(len(x)), 0)
    return nodes


@dataclass
class IsolationForestModel:
    feature: np.ndarray     # [tree, node]
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf_h: np.ndarray      # depth + c(size) at leaves
    max_depth: int
    sample_size: int


def tree_samples(df: DataFrame, cols: Sequence[str], key: str, n_trees: int = 100, sample_size: int = 256,
                 seed: int = 42) -> tuple[DataFrame, int]:
    """The rows that each tree is grown on (``key``, ``cols``, ``tree``) and
    their number per tree: at most ``sample_size``, without replacement."""
    n = df.count()
    m = int(min(sample_size, n))
    rate = min(1.0, 4.0 * m / max(n, 1))
    trees = F.sequence(F.lit(0), F.lit(n_trees - 1))
    x = df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    # one hash per row decides whether it can be in any tree (probability
    # n_trees * rate); only those rows draw a hash per tree, at rate / p_any,
    # so every tree still samples each row with probability ``rate``
    p_any = min(1.0, n_trees * rate)
    x = x.filter(stable_uniform(key, F.lit("any"), seed) < p_any)
    cond = rate / p_any
    cand = x.withColumn("tree", F.explode(F.filter(trees, lambda t: stable_uniform(key, t, seed) < cond)))
    cand = cand.withColumn("_u", stable_uniform(key, F.col("tree"), seed))
    w = Window.partitionBy("tree").orderBy("_u", key)
    return cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= m).drop("_r", "_u"), m


def fit_isolation_forest(df: DataFrame, cols: Sequence[str], key: str, n_trees: int = 100,
                         sample_size: int = 256, seed: int = 42) -> IsolationForestModel:
    cols = list(cols)
    sample, m = tree_samples(df, cols, key, n_trees, sample_size, seed)
    max_depth = max(1, math.ceil(math.log2(max(m, 2))))

    def fit_group(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        rows = grow_tree(pdf[cols].to_numpy(dtype="float64"), t, max_depth, seed)
        return pd.DataFrame(rows, columns=[f.name for f in NODE_SCHEMA.fields])

    nodes = sample.groupBy("tree").applyInPandas(fit_group, NODE_SCHEMA).toPandas()
    width = int(nodes.groupby("tree")["node"].max().max()) + 1
    shape = (n_trees, width)
    feat = np.full(shape, -1, dtype=np.int64)
    thr = np.zeros(shape)
    left = np.zeros(shape, dtype=np.int64)
    right = np.zeros(shape, dtype=np.int64)
    leaf_h = np.zeros(shape)
    t, k = nodes["tree"].to_numpy(), nodes["node"].to_numpy()
    feat[t, k] = nodes["feature"].to_numpy()
    thr[t, k] = nodes["threshold"].to_numpy()
    left[t, k] = nodes["left"].to_numpy()
    right[t, k] = nodes["right"].to_numpy()
    leaf_h[t, k] = nodes["depth"].to_numpy() + np.array([c_factor(s) for s in nodes["size"].to_numpy()])
    return IsolationForestModel(feat, thr, left, right, leaf_h, max_depth, m)


def score_isolation_forest(model: IsolationForestModel, df: DataFrame, cols: Sequence[str],
                           out: str = "anomaly_score") -> DataFrame:
    """Adds ``out`` = ``2 ** (-mean path length / c(sample_size))``."""
    cols = list(cols)
    b = df.sparkSession.sparkContext.broadcast(model)
    norm = c_factor(model.sample_size)

    @F.pandas_udf(T.DoubleType())
    def iso_score(*xs: pd.Series) -> pd.Series:
        mdl = b.value
        x = np.column_stack([s.to_numpy(dtype="float64") for s in xs])
        rows = np.arange(len(x))
        total = np.zeros(len(x))
        for t in range(mdl.feature.shape[0]):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(mdl.max_depth + 1):
                f = mdl.feature[t, node]
                inner = f >= 0
                if not inner.any():
                    break
                v = x[rows, np.where(inner, f, 0)]
                nxt = np.where(v <= mdl.threshold[t, node], mdl.left[t, node], mdl.right[t, node])
                node = np.where(inner, nxt, node)
            total += mdl.leaf_h[t, node]
        mean_h = total / mdl.feature.shape[0]
        return pd.Series(np.power(2.0, -mean_h / norm) if norm > 0 else np.ones(len(x)))

    args = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]
    return df.withColumn(out, iso_score(*args))
