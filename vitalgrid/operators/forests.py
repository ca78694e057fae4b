"""Random forests on a bounded table, many forests at once.

Spark ML's forests hold the sums of all bins of every open node in every task
and exchange them level by level, so deep trees cost nodes x bins x tasks. The
trees of a forest need nothing of each other: a training table that fits one
block (``boosting.binned``: a byte a feature and row) goes to tasks that grow
``PIECE`` trees each, all forests in one job. A level costs the rows that are
still open, whatever the number of nodes: rows stay in order of their bins
within their node, and the splits of all nodes come from running sums.

The method is that of Spark ML's classifier: Poisson bootstrap, Gini gain of
weighted rows, a random subset of features for every node, at most ``BINS``
bins, least rows (drawn ones, repeats counted) of a child. Draws depend on the
seed, the tree's number and the rows only, not on partitions. Fitted forests
become Spark ML ``RandomForestClassificationModel``s (``trees.ensemble``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.operators.boosting import BLOCK_ROWS, Block, binned, thresholds
from vitalgrid.operators.features import fill_features
from vitalgrid.operators.trees import NODES, ensemble
from vitalgrid.session import materialize

#: Bins of a feature, and trees that one task grows.
BINS = 64
PIECE = 25


@dataclass(frozen=True)
class Spec:
    """One forest, fitted on the rows outside fold ``left_out`` (None: all rows). ``features`` of a node: ``sqrt``,
    ``log2`` or ``all``."""

    trees: int = 100
    max_depth: int = 14
    min_rows: int = 1
    features: str = "sqrt"
    left_out: int | None = None
    seed: int = 42

    def subset(self, features: int) -> int:
        """Features that a node looks at."""
        return {"sqrt": math.ceil(math.sqrt(features)), "log2": max(1, math.ceil(math.log2(features))),
                "all": features}[self.features]


@dataclass
class Nodes:
    """A tree, parents before children: split feature and last bin to the left (-1, -1 for a leaf), children, share of
    class 1, weight of the rows and Gini gain."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    rows: np.ndarray
    gain: np.ndarray

    def values_of(self, bins: np.ndarray) -> np.ndarray:
        """Value of the leaf in which every row (a column of ``bins``) ends."""
        at = np.zeros(bins.shape[1], np.int32)
        moving = np.flatnonzero(self.left[at] >= 0)
        while len(moving):
            node = at[moving]
            at[moving] = np.where(bins[self.feature[node], moving] <= self.bin[node], self.left[node], self.right[node])
            moving = moving[self.left[at[moving]] >= 0]
        return self.value[at]


def _impure(pos: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Half the Gini impurity times the weight."""
    return pos * (all_ - pos) / all_


def _best_splits(bins: np.ndarray, order: list[np.ndarray], node: np.ndarray, sums: tuple, total: tuple, spec: Spec,
                 looks: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain (weight times half the Gini gain), feature (-1: none) and last bin to the left of every open node's best
    split, the first one in a tie. ``order`` has the open rows of each feature by node and bin."""
    open_ = looks.shape[0]
    best, feature, last = np.full(open_, least), np.full(open_, -1, np.int32), np.full(open_, -1, np.int32)
    n, w, p = total
    parent = _impure(p, w)
    for f in range(len(bins)):
        o = order[f]
        o = o[looks[node[o], f]]
        nd, b = node[o], bins[f][o]
        # a split lies after the last row of a bin, if more rows of the node follow
        new = nd[1:] != nd[:-1]
        end = np.flatnonzero(~new & (b[1:] != b[:-1]))
        if not len(end):
            continue
        at = nd[end]
        begin = np.zeros(open_, np.int64)
        first = np.flatnonzero(new) + 1
        begin[nd[first]] = first
        nl, wl, pl = (run[end + 1] - run[begin[at]] for run in (np.concatenate([[0], s[o].cumsum()]) for s in sums))
        nr, wr, pr = n[at] - nl, w[at] - wl, p[at] - pl
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = parent[at] - _impure(pl, wl) - _impure(pr, wr)
        gain = np.where((nl >= spec.min_rows) & (nr >= spec.min_rows) & (wl > 0) & (wr > 0), gain, -np.inf)
        starts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        top = np.maximum.reduceat(gain, starts)
        hit = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(starts, len(at)))))
        hit = hit[np.concatenate([[True], at[hit[1:]] != at[hit[:-1]]])]
        of = at[starts]
        better = top > best[of]
        of, hit = of[better], hit[better]
        best[of], feature[of], last[of] = top[better], f, b[end[hit]]
    return best, feature, last


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, spec: Spec, tree: int) -> Nodes:
    """Tree ``tree`` on rows (columns of ``bins``) with labels and weights, level by level."""
    rng = np.random.default_rng([spec.seed, tree])
    drawn = rng.poisson(1.0, len(y))
    rows = np.flatnonzero(drawn)
    bins, n = np.ascontiguousarray(bins[:, rows]), drawn[rows].astype(np.float64)
    sums = n, n * w[rows], n * w[rows] * y[rows]
    ones = n * y[rows]
    size, k = max(1, 2 * len(rows)), spec.subset(len(bins))
    feature, last, left, right = (np.full(size, -1, np.int32) for _ in range(4))
    value, weight, gain = (np.zeros(size) for _ in range(3))
    made, depth = 1, 0
    total = tuple(np.array([s.sum()]) for s in sums)
    weight[0] = total[1][0]
    value[0] = total[2][0] / weight[0] if weight[0] > 0 else 0.0
    # sums of the same rows in another order differ in the last digits: no gain
    least = 1e-8 * max(w[rows].max(initial=0.0), 1e-300)
    ids = np.arange(1) if 0 < ones.sum() < n.sum() else np.empty(0, np.int64)
    node = np.zeros(len(rows), np.int32)
    order = [np.argsort(b, kind="stable") for b in bins]
    while len(ids) and depth < spec.max_depth:
        draw = rng.random((len(ids), len(bins)))
        looks = draw <= np.sort(draw, axis=1)[:, k - 1:k]
        best, f, b = _best_splits(bins, order, node, sums, total, spec, looks, least)
        split = np.flatnonzero(f >= 0)
        if not len(split):
            break
        up, children = ids[split], made + np.arange(2 * len(split))
        feature[up], last[up], left[up], right[up] = f[split], b[split], children[::2], children[1::2]
        gain[up] = 2 * best[split] / total[1][split]
        made, depth = made + len(children), depth + 1
        number = np.full(len(ids), -1)
        number[split] = np.arange(len(split))
        live = order[0]
        live = live[f[node[live]] >= 0]
        of = node[live]
        child = 2 * number[of] + (bins[f[of], live] > b[of])
        totals = tuple(np.bincount(child, s[live], len(children)) for s in sums)
        class_1 = np.bincount(child, ones[live], len(children))
        weight[children], value[children] = totals[1], totals[2] / totals[1]
        open_ = (class_1 > 0) & (class_1 < totals[0]) & (totals[0] >= 2 * spec.min_rows)
        ids, total = children[open_], tuple(t[open_] for t in totals)
        node[:] = -1
        node[live] = np.where(open_, open_.cumsum() - 1, -1)[child]
        for i, o in enumerate(order):
            of = node[o]
            o, of = o[of >= 0], of[of >= 0]
            # short integers are sorted in linear time
            order[i] = o[np.argsort(of.astype(np.uint16) if len(ids) < 1 << 16 else of, kind="stable")]
    return Nodes(*(x[:made] for x in (feature, last, left, right, value, weight, gain)))


def _pieces(blocks: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """The block beside every forest's pieces (first tree of each), a partition a piece."""
    pieces = [(m, t) for m, s in enumerate(specs) for t in range(0, s.trees, PIECE)]
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("piece"), F.lit(m).alias("model"), F.lit(t).alias("first"))
                             for i, (m, t) in enumerate(pieces)])).alias("at")
    return blocks.select("*", at).select("bins", "rest", "rows", "at.*").repartitionByRange(len(pieces), "piece")


def _trees(row: dict, spec: Spec) -> tuple[Block, Iterator[tuple[int, Nodes]]]:
    block = Block(row["bins"], row["rest"], row["rows"])
    seen = np.ones(len(block.y), bool) if spec.left_out is None else block.fold != spec.left_out
    if not seen.any():
        raise ValueError(f"no rows outside fold {spec.left_out} to fit a forest on")
    bins, y, w = block.bins[:, seen], block.y[seen], block.w[seen]
    return block, ((t, grow(bins, y, w, spec, t)) for t in range(row["first"], min(row["first"] + PIECE, spec.trees)))


def bin_bounds(rows: DataFrame, cols: Sequence[str]) -> list[np.ndarray]:
    """Upper bounds of all but the last bin of every feature: between all values if there are at most ``BINS``, else
    between as many quantiles."""
    out = thresholds(rows, cols, BINS - 1)
    for i, c in enumerate(cols):
        few = rows.select(F.col(c).cast("double").alias("x")).distinct().limit(BINS + 1).collect()
        if len(few) <= BINS:
            values = np.unique([r["x"] for r in few])
            out[i] = (values[:-1] + values[1:]) / 2
    return out


class Table:
    """Training rows in bins, in one block, for any number of forests. Missing cells count 0."""

    def __init__(self, train: DataFrame, cols: Sequence[str], label: str, weight: str, fold: str | None = None):
        self.cols = list(cols)
        rows = fill_features(train, self.cols)
        rows = materialize(rows.select(*self.cols, F.col(label).alias("_y"), F.col(weight).alias("_w"),
                                       *([F.col(fold).alias("_f")] if fold else [])), "forest-rows")
        n = rows.count()
        if not 0 < n <= BLOCK_ROWS:
            raise ValueError(f"{n} rows: forests in tasks take 1 to {BLOCK_ROWS}")
        self.bounds = bin_bounds(rows, self.cols)
        self.blocks = materialize(binned(rows, self.cols, "_y", "_w", "_f" if fold else None, self.bounds, n),
                                  "forest-block")

    def fit(self, specs: Sequence[Spec]) -> list:
        """A Spark ML model for every forest."""
        specs, bounds = list(specs), self.bounds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    for t, x in _trees(row, specs[row["model"]])[1]:
                        at = [bounds[f][b] if f >= 0 else -1.0 for f, b in zip(x.feature, x.bin, strict=True)]
                        n = len(at)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, row["model"], np.int32)), pa.array(np.full(n, t, np.int32)),
                             pa.array(np.arange(n, dtype=np.int32)), pa.array(x.feature), pa.array(at, pa.float64()),
                             pa.array(x.left), pa.array(x.right), pa.array(x.value), pa.array(x.rows), pa.array(x.gain)],
                            ["model", "tree", "node", "feature", "threshold", "left", "right", "value", "rows", "gain"])

        nodes = materialize(_pieces(self.blocks, specs).mapInArrow(run, f"model int, {NODES}"), "forest-nodes")
        models = [ensemble(nodes.filter(F.col("model") == m).drop("model"), "forest", len(self.cols), s.trees)
                  for m, s in enumerate(specs)]
        for m, s in zip(models, specs, strict=True):
            for param, value in ((m.maxDepth, s.max_depth), (m.minInstancesPerNode, s.min_rows), (m.maxBins, BINS),
                                 (m.featureSubsetStrategy, s.features), (m.seed, s.seed)):
                m.set(param, value)
        return models

    def held_scores(self, specs: Sequence[Spec]) -> DataFrame:
        """``model int, label int, risk_score double`` of the rows in the fold that each forest leaves out."""
        specs = list(specs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    spec = specs[row["model"]]
                    block, trees = _trees(row, spec)
                    out = block.fold == spec.left_out
                    bins = np.ascontiguousarray(block.bins[:, out])
                    score = sum(x.values_of(bins) for _, x in trees)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["model"]], pa.int32()), pa.array([row["first"]], pa.int32()),
                         pa.array([block.y[out].tobytes()], pa.binary()), pa.array([score.tobytes()], pa.binary())],
                        ["model", "first", "y", "score"])

        def mean(pieces: pd.DataFrame) -> pd.DataFrame:
            pieces = pieces.sort_values("first")
            m = int(pieces["model"].iloc[0])
            score = sum(np.frombuffer(s) for s in pieces["score"]) / specs[m].trees
            return pd.DataFrame({"model": m, "label": np.frombuffer(pieces["y"].iloc[0]).astype(np.int32),
                                 "risk_score": score})

        told = materialize(_pieces(self.blocks, specs).mapInArrow(run, "model int, first int, y binary, score binary"),
                           "forest-held")
        return told.groupBy("model").applyInPandas(mean, "model int, label int, risk_score double")
