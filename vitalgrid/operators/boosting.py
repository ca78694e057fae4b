"""Histogram gradient boosting, many models at once.

Rows are binned once (at most 255 bins a feature) and written as blocks of at
most ``BLOCK_ROWS`` rows. A tree grows best-first to a number of leaves: the sums
of gradients, hessians and rows per (model, node, feature, bin) decide its
splits. With several blocks every Spark job gives the histograms that all
models are waiting for: tasks sum over their blocks, an exchange by (model,
node) sums over tasks (the driver where there are at most ``FEW`` tasks), and the
driver gets tables whose size depends on models, leaves and features only. If all rows fit one block, its histograms are
the whole ones, so one job fits all models, each in a task of its own. Both
ways run the same growth and give the same trees.

Fitted ensembles become Spark ML ``GBTClassificationModel``s, so scoring and
importances run in the JVM.
"""

from __future__ import annotations

import pickle
from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.operators.features import fill_features
from vitalgrid.operators.trees import NODES, ensemble
from vitalgrid.session import discard, materialize

#: Rows of a block, and bins of a feature.
BLOCK_ROWS = 1 << 19
BINS = 255
#: Tasks whose histograms the driver sums itself, which saves each of the many jobs an exchange.
FEW = 16
#: Least sum of hessians on either side of a split.
MIN_HESSIAN = 1e-3


@dataclass(frozen=True)
class Spec:
    """One model: ``max_iter`` trees of at most ``leaves`` leaves and ``max_depth`` levels (None: any), steps of
    ``step``, at least ``min_leaf`` rows a leaf, L2 penalty ``l2``; fitted on ``columns`` (positions; None: all) of
    the rows outside fold ``left_out`` (None: all rows). With ``patience`` a tenth of these rows, drawn by ``seed``, are
    held back, and growth stops when their loss has not improved for that many trees."""

    max_iter: int = 100
    step: float = 0.1
    max_depth: int | None = None
    min_leaf: int = 20
    l2: float = 0.0
    leaves: int = 31
    columns: tuple[int, ...] | None = None
    left_out: int | None = None
    patience: int = 0
    seed: int = 42


@dataclass
class Tree:
    """Nodes by number: split feature and last bin to the left (-1, -1 for a leaf), children, value, gain and rows."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    rows: list[float] = field(default_factory=list)

    def add(self, value: float, rows: float) -> int:
        for column, x in ((self.feature, -1), (self.bin, -1), (self.left, -1), (self.right, -1), (self.value, value),
                          (self.gain, 0.0), (self.rows, rows)):
            column.append(x)
        return len(self.feature) - 1

    def nodes_of(self, bins: np.ndarray) -> np.ndarray:
        """Node in which every row (a column of ``bins``) ends."""
        at = np.zeros(bins.shape[1], np.int32)
        feature, last, left, right = (np.array(x, np.int32) for x in (self.feature, self.bin, self.left, self.right))
        moving = np.arange(len(at)) if left[0] >= 0 else np.empty(0, np.int64)
        while len(moving):
            node = at[moving]
            at[moving] = np.where(bins[feature[node], moving] <= last[node], left[node], right[node])
            moving = moving[left[at[moving]] >= 0]
        return at


def histogram(bins: np.ndarray, rows: np.ndarray, sums: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """(columns, bins, 3) sums of gradients, hessians and counts over ``rows``."""
    cell = (bins[np.ix_(columns, rows)].astype(np.int32) + (np.arange(len(columns), dtype=np.int32) * (BINS + 1))[:, None]).ravel()
    out = [np.bincount(cell, weights=np.tile(s[rows], len(columns)), minlength=len(columns) * (BINS + 1)) for s in sums]
    return np.stack(out, axis=-1).reshape(len(columns), BINS + 1, 3)


def best_split(hist: np.ndarray, spec: Spec) -> tuple[float, int, int] | None:
    """(gain, column, last bin to the left) of the best split, the first one in a tie. Gains that agree to nine digits
    are a tie: sums of the same rows in another order differ in the last ones."""
    total = hist[0].sum(axis=0)
    left = hist.cumsum(axis=1)[:, :-1]
    right = total - left
    (gl, hl, nl), (gr, hr, nr) = (np.moveaxis(x, -1, 0) for x in (left, right))
    may = (nl >= spec.min_leaf) & (nr >= spec.min_leaf) & (hl >= MIN_HESSIAN) & (hr >= MIN_HESSIAN)
    if not may.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl * gl / (hl + spec.l2) + gr * gr / (hr + spec.l2) - total[0] ** 2 / (total[1] + spec.l2)
    gain = np.where(may, gain, -np.inf)
    best = gain.max()
    if best <= 1e-12:
        return None
    c, b = divmod(int(np.argmax(gain >= best * (1 - 1e-9))), gain.shape[1])
    return float(f"{best:.8e}"), c, b


def grow(spec: Spec, columns: np.ndarray, ahead: bool) -> Generator[tuple[Tree, list[int]], dict[int, np.ndarray], Tree]:
    """One tree, best-first. Yields (tree so far, nodes whose histograms are wanted) and is sent the histograms.

    The smaller child's histogram is asked for, its sibling's is the
    difference. With ``ahead`` the children of every leaf that may still be
    split are asked for together, which saves jobs and changes no split; those
    never reached are cut off in the end."""
    tree, open_, hists, path = Tree(), {}, {}, {}  # path: L and R from the root on
    waiting: dict[int, tuple[int, int]] = {}  # children made, histograms not known

    def value(hist: np.ndarray) -> float:
        g, h, _ = hist[0].sum(axis=0)
        return float(-spec.step * g / (h + spec.l2)) if h + spec.l2 > 0 else 0.0

    def known(node: int, hist: np.ndarray) -> None:
        tree.value[node], tree.rows[node] = value(hist), float(hist[0, :, 2].sum())
        if (spec.max_depth is None or len(path[node]) < spec.max_depth) and (found := best_split(hist, spec)):
            open_[node], hists[node] = found, hist

    def divide(node: int) -> tuple[int, int]:
        gain, c, b = open_[node]
        small = hists[node][c, :b + 1].sum(axis=0)[2] * 2 <= hists[node][c].sum(axis=0)[2]
        children = tree.add(0.0, 0.0), tree.add(0.0, 0.0)
        tree.feature[node], tree.bin[node] = int(columns[c]), b
        tree.left[node], tree.right[node] = children
        tree.gain[node] = gain
        path[children[0]], path[children[1]] = path[node] + "L", path[node] + "R"
        waiting[node] = (children[0], children[1]) if small else (children[1], children[0])
        return children

    root = tree.add(0.0, 0.0)
    path[root] = ""
    known(root, (yield tree, [root])[root])
    frontier, made, leaves = {root}, {}, 1
    while leaves < spec.leaves:
        able = sorted((n for n in frontier if n in open_), key=lambda n: (-open_[n][0], path[n]))
        if not able:
            break
        top = able[0]
        if top not in made:
            for node in able[:spec.leaves - leaves] if ahead else [top]:
                if node not in made:
                    made[node] = divide(node)
            got = yield tree, [small for small, _ in waiting.values()]
            for node, (small, large) in waiting.items():
                known(small, got[small])
                known(large, hists[node] - got[small])
            waiting.clear()
        frontier.remove(top)
        frontier.update(made[top])
        del hists[top]
        leaves += 1
    return _pruned(tree, frontier)


def _pruned(tree: Tree, leaves: set[int]) -> Tree:
    """The tree down to ``leaves``, numbered in preorder."""
    out = Tree()

    def copy(node: int) -> int:
        new = out.add(tree.value[node], tree.rows[node])
        if node not in leaves:
            out.feature[new], out.bin[new], out.gain[new] = tree.feature[node], tree.bin[node], tree.gain[node]
            out.left[new] = copy(tree.left[node])
            out.right[new] = copy(tree.right[node])
        return new

    copy(0)
    return out


class Block:
    """Rows of a block: bins (features x rows), labels, weights, folds and a hash of each row."""

    def __init__(self, bins: bytes, rest: bytes, rows: int):
        self.bins = np.frombuffer(bins, np.uint8).reshape(-1, rows)
        self.y, self.w, self.fold = np.frombuffer(rest[:24 * rows], np.float64).reshape(3, rows)
        self.hash = np.frombuffer(rest[24 * rows:], np.uint64)

    def seen(self, spec: Spec) -> np.ndarray:
        """Rows outside the fold that is left out."""
        return np.ones(len(self.y), bool) if spec.left_out is None else self.fold != spec.left_out

    def held_back(self, spec: Spec) -> np.ndarray:
        """The tenth of the rows that early stopping looks at."""
        if not spec.patience:
            return np.zeros(len(self.y), bool)
        with np.errstate(over="ignore"):
            x = (self.hash ^ np.uint64(spec.seed * 0x9E3779B97F4A7C15 % 2 ** 64)) * np.uint64(0xBF58476D1CE4E5B9)
        return self.seen(spec) & ((x >> np.uint64(33)) % np.uint64(10) == 0)

    def sums(self, spec: Spec, score: np.ndarray) -> np.ndarray:
        """Gradients and hessians of the weighted logistic loss, and counts, zero for rows that are not fitted."""
        p, inside = 1 / (1 + np.exp(-score)), (self.seen(spec) & ~self.held_back(spec)).astype(float)
        return np.stack([self.w * (p - self.y) * inside, self.w * p * (1 - p) * inside, inside])

    def loss(self, spec: Spec, score: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of the rows held back, and their weight."""
        back = self.held_back(spec)
        y, w, s = self.y[back], self.w[back], score[back]
        return np.array([(w * (np.logaddexp(0, s) - y * s)).sum(), w.sum()])


def enough(spec: Spec, losses: list[float]) -> bool:
    """No loss of the last ``patience`` trees is below the one before them."""
    return bool(spec.patience) and len(losses) > spec.patience and min(losses[-spec.patience:]) >= losses[-spec.patience - 1] - 1e-7


def _columns(spec: Spec, features: int) -> np.ndarray:
    return np.arange(features) if spec.columns is None else np.array(spec.columns)


def _fit_block(block: Block, spec: Spec, start: float) -> tuple[list[Tree], np.ndarray]:
    """All trees of a model whose rows are one block, and the rows' scores."""
    score, trees, columns = np.full(len(block.y), start), [], _columns(spec, len(block.bins))
    losses: list[float] = []
    for _ in range(spec.max_iter):
        loss, weight = block.loss(spec, score)
        losses.append(loss / max(weight, 1e-300))
        if enough(spec, losses):
            break
        sums = block.sums(spec, score)
        members: dict[int, np.ndarray] = {0: np.arange(len(score))}
        growth = grow(spec, columns, ahead=False)
        tree, wanted = next(growth)
        try:
            while True:
                for node in wanted:
                    if node and node not in members:
                        up = tree.left.index(node) if node in tree.left else tree.right.index(node)
                        goes = block.bins[tree.feature[up], members[up]] <= tree.bin[up]
                        members[tree.left[up]], members[tree.right[up]] = members[up][goes], members[up][~goes]
                tree, wanted = growth.send({n: histogram(block.bins, members[n], sums, columns) for n in wanted})
        except StopIteration as end:
            tree = end.value
        trees.append(tree)
        score += np.array(tree.value)[tree.nodes_of(block.bins)]
    return trees, score


def _fit_in_tasks(specs: list[Spec], starts: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["bins"], row["rest"], row["rows"])
                trees, score = _fit_block(block, specs[row["model"]], starts[row["model"]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["model"]], pa.int32()), pa.array([pickle.dumps(trees)], pa.binary()),
                     pa.array([_held(block, specs[row["model"]], score)], pa.binary())], ["model", "trees", "held"])

    return run


def _held(block: Block, spec: Spec, score: np.ndarray) -> bytes:
    """Labels and scores of the rows a model did not see."""
    out = ~block.seen(spec)
    return np.stack([block.y[out], score[out]]).tobytes()


def _partial(specs: list[Spec], asked: dict[int, tuple[Tree, list[int]]]):
    """Histograms of the asked nodes, and under node -1 the loss of the rows held back, summed over the blocks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["bins"], row["rest"], row["rows"])
                scores = np.frombuffer(row["scores"]).reshape(len(specs), -1)
                for m, (tree, nodes) in asked.items():
                    sums, columns = block.sums(specs[m], scores[m]), _columns(specs[m], len(block.bins))
                    paths = _members(tree, block.bins, set(nodes))
                    parts = {n: histogram(block.bins, paths[n], sums, columns) for n in nodes}
                    if specs[m].patience and nodes == [0]:
                        parts[-1] = block.loss(specs[m], scores[m])
                    for node, got in parts.items():
                        total[m, node] = total[m, node] + got if (m, node) in total else got
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([m for m, _ in keys], pa.int32()), pa.array([n for _, n in keys], pa.int32()),
             pa.array([total[k].tobytes() for k in keys], pa.binary())], ["model", "node", "hist"])

    return run


def _members(tree: Tree, bins: np.ndarray, wanted: set[int]) -> dict[int, np.ndarray]:
    """Rows of each wanted node."""
    out, stack = {}, [(0, np.arange(bins.shape[1]))]
    while stack:
        node, rows = stack.pop()
        if node in wanted:
            out[node] = rows
        if tree.left[node] >= 0:
            goes = bins[tree.feature[node], rows] <= tree.bin[node]
            stack += [(tree.left[node], rows[goes]), (tree.right[node], rows[~goes])]
    return out


def _total(frame: pd.DataFrame) -> pd.DataFrame:
    hists = sum(np.frombuffer(h) for h in frame["hist"])
    return pd.DataFrame({"model": frame["model"].iloc[:1], "node": frame["node"].iloc[:1], "hist": [hists.tobytes()]})


def _rescore(fresh: dict[int, Tree], models: int):
    """Blocks whose scores have one tree more of some models."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["bins"], row["rest"], row["rows"])
                scores = np.frombuffer(row["scores"]).reshape(models, -1).copy()
                for m, tree in fresh.items():
                    scores[m] += np.array(tree.value)[tree.nodes_of(block.bins)]
                row["scores"] = scores.tobytes()
                yield pa.RecordBatch.from_pylist([row], schema=batch.schema)

    return run


_BLOCK = "bins binary, rest binary, rows int"
_HIST = "model int, node int, hist binary"


def _fit_in_jobs(blocks: DataFrame, specs: list[Spec], starts: list[float], features: int):
    """Trees of all models, grown side by side, and the blocks with their final scores. A tree takes a job for each of its
    levels, which reads every row, so scores are written after every tree, in place of those before it."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.repeat(np.array(starts), r).tobytes() for r in batch.column("rows").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.binary())],
                                             [*batch.schema.names, "scores"])

    kind = f"{_BLOCK}, scores binary"
    blocks = materialize(blocks.mapInArrow(first, kind), "boost-scores")
    few = len(specs) == 1 and blocks.rdd.getNumPartitions() <= FEW
    trees: list[list[Tree]] = [[] for _ in specs]
    losses: list[list[float]] = [[] for _ in specs]
    for turn in range(max(s.max_iter for s in specs)):
        growths = {m: grow(s, _columns(s, features), ahead=True) for m, s in enumerate(specs)
                   if turn < s.max_iter and not enough(s, losses[m])}
        if not growths:
            break
        asked, fresh = {m: next(g) for m, g in growths.items()}, {}
        while asked:
            got: dict[int, dict[int, np.ndarray]] = {m: {} for m in asked}
            parts = blocks.mapInArrow(_partial(specs, asked), _HIST)
            if not few:
                parts = parts.groupBy("model", "node").applyInPandas(_total, _HIST)
            sums: dict[tuple[int, int], np.ndarray] = {}
            for r in parts.collect():
                key, hist = (r["model"], r["node"]), np.frombuffer(r["hist"])
                sums[key] = sums[key] + hist if key in sums else hist
            for (m, node), hist in sums.items():
                if node < 0:
                    losses[m].append(hist[0] / max(hist[1], 1e-300))
                else:
                    got[m][node] = hist.reshape(-1, BINS + 1, 3)
            after = {}
            for m in asked:
                if enough(specs[m], losses[m]):
                    continue
                try:
                    after[m] = growths[m].send(got[m])
                except StopIteration as end:
                    fresh[m] = end.value
                    trees[m].append(end.value)
            asked = after
        if fresh:
            before, blocks = blocks, materialize(blocks.mapInArrow(_rescore(fresh, len(specs)), kind), "boost-scores")
            discard(before)
    return trees, blocks


def thresholds(train: DataFrame, cols: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper bounds of all but the last bin of every feature, from one aggregate: halfway between neighbours of at
    most ``bins`` quantiles (all values where there are no more)."""
    at = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    row = train.agg(*[F.percentile_approx(c, at, 20_000).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    out = []
    for got in row or [None] * len(cols):
        values = np.unique(np.array(got or [], float))
        out.append((values[:-1] + values[1:]) / 2)
    return out


def binned(train: DataFrame, cols: Sequence[str], label: str, weight: str, fold: str | None,
           bounds: list[np.ndarray], block_rows: int) -> DataFrame:
    """Blocks of binned rows; rows are put in order within a partition, so equal tables give equal blocks."""
    names = [f"c{i}" for i in range(len(cols))]
    rows = train.select(*[F.col(c).cast("double").alias(n) for c, n in zip(cols, names, strict=True)],
                        F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w"),
                        (F.col(fold) if fold else F.lit(-1)).cast("double").alias("fold"))
    rows = rows.withColumn("hash", F.xxhash64(*rows.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def emit(table: pa.Table) -> pa.RecordBatch:
            bins = np.stack([np.searchsorted(b, table[n].to_numpy(), side="left").astype(np.uint8)
                             for n, b in zip(names, bounds, strict=True)])
            rest = b"".join(table[n].to_numpy().tobytes() for n in ("y", "w", "fold", "hash"))
            return pa.RecordBatch.from_arrays([pa.array([bins.tobytes()], pa.binary()), pa.array([rest], pa.binary()),
                                               pa.array([table.num_rows], pa.int32())], ["bins", "rest", "rows"])

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= block_rows:
                table = pa.Table.from_batches(held)
                yield emit(table.slice(0, block_rows))
                held, count = table.slice(block_rows).to_batches(), count - block_rows
        if count:
            yield emit(pa.Table.from_batches(held))

    count = train.count()
    parts = max(1, -(-count // block_rows))
    if parts > 1:  # every core has a share of the rows
        cores = train.sparkSession.sparkContext.defaultParallelism
        parts = -(-parts // cores) * cores
    return rows.repartition(parts).sortWithinPartitions(*rows.columns).mapInArrow(run, _BLOCK)


@dataclass
class Fitted:
    """A fitted ensemble: score before the first tree, trees, bin bounds; as a Spark ML model by ``spark_model``."""

    spec: Spec
    start: float
    trees: list[Tree]
    bounds: list[np.ndarray]

    def spark_model(self, spark) -> GBTClassificationModel:
        """The ensemble as a Spark ML model, whose logistic loss doubles the margin, so values are halved; the start
        is a tree of one leaf. Bin bounds are the thresholds."""
        place = {c: i for i, c in enumerate(_columns(self.spec, len(self.bounds)).tolist())}
        root = Tree()
        root.add(self.start, 1.0)
        rows = []
        for t, tree in enumerate([root, *self.trees]):
            for n in range(len(tree.feature)):
                leaf = tree.left[n] < 0
                count = max(float(tree.rows[n]), 1.0)
                rows.append((t, n, -1 if leaf else place[tree.feature[n]],
                             -1.0 if leaf else float(self.bounds[tree.feature[n]][tree.bin[n]]), tree.left[n], tree.right[n],
                             tree.value[n] / 2, count, -1.0 if leaf else tree.gain[n] / count))
        return ensemble(spark.createDataFrame(rows, NODES), "boosting", len(place), len(self.trees) + 1)


def fit_many(train: DataFrame, cols: Sequence[str], label: str, specs: Sequence[Spec], weight: str,
             fold: str | None = None, block_rows: int = BLOCK_ROWS) -> tuple[list[Fitted], DataFrame]:
    """Fits all ``specs`` on one binned table of ``train`` (missing cells count 0).

    Returns the ensembles and ``model int, label int, risk_score double``: the
    probabilities of the rows that each model did not see (its fold left out).
    An empty table raises. Only the rows held back for early stopping depend on
    the seed."""
    spark, specs = train.sparkSession, list(specs)
    rows = fill_features(train, list(cols))
    rows = materialize(rows.select(*cols, F.col(label).alias("_y"), F.col(weight).alias("_w"),
                                   *([F.col(fold).alias("_f")] if fold else [])), "boost-rows")
    bounds = thresholds(rows, cols)
    blocks = materialize(binned(rows, cols, "_y", "_w", "_f" if fold else None, bounds, block_rows), "boost-blocks")
    seen = [F.lit(True) if s.left_out is None else F.col("_f") != s.left_out for s in specs]
    sums = rows.agg(*[F.sum(F.when(c, F.col("_w") * F.col("_y"))).alias(f"p{i}") for i, c in enumerate(seen)],
                    *[F.sum(F.when(c, F.col("_w"))).alias(f"w{i}") for i, c in enumerate(seen)]).first()
    starts = []
    for i in range(len(specs)):
        share = np.clip(float(sums[f"p{i}"]) / float(sums[f"w{i}"]), 1e-12, 1 - 1e-12)
        starts.append(float(np.log(share / (1 - share))))
    if blocks.count() == 1:
        models = F.explode(F.sequence(F.lit(0), F.lit(len(specs) - 1))).alias("model")
        each = blocks.select("*", models).repartitionByRange(len(specs), "model")
        got = materialize(each.mapInArrow(_fit_in_tasks(specs, starts), "model int, trees binary, held binary"), "boosted")
        trees = {r["model"]: pickle.loads(r["trees"]) for r in got.select("model", "trees").collect()}
        fitted = [Fitted(s, starts[m], trees[m], bounds) for m, s in enumerate(specs)]
        held = got.select("model", "held")
    else:
        grown, scored = _fit_in_jobs(blocks, specs, starts, len(cols))
        fitted = [Fitted(s, starts[m], grown[m], bounds) for m, s in enumerate(specs)]

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    block = Block(row["bins"], row["rest"], row["rows"])
                    scores = np.frombuffer(row["scores"]).reshape(len(specs), -1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(range(len(specs)), pa.int32()),
                         pa.array([_held(block, s, scores[m]) for m, s in enumerate(specs)], pa.binary())], ["model", "held"])

        held = scored.mapInArrow(split, "model int, held binary")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                y, score = np.frombuffer(row["held"]).reshape(2, -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(y), row["model"], np.int32)), pa.array(y.astype(np.int32)),
                     pa.array(1 / (1 + np.exp(-score)))], ["model", "label", "risk_score"])

    return fitted, held.mapInArrow(rows_of, "model int, label int, risk_score double")
