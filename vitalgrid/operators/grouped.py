"""Grouped training of a small MLP with weighted parameter averaging.

Each model being trained is a *group*: a seed, a setup (``central`` — one model
on the pooled client samples, ``local`` — one model per client, ``fed`` — one
model per client restarted from the averaged model every round) and a client.
One full-batch optimiser step for **all** groups is one Spark job:

* rows are packed once into blocks of at most ``BLOCK_ROWS`` rows that feed the
  same groups, so no step takes rows apart;
* a pass over the blocks runs forward and backward (NumPy) for every group's
  current parameters and emits one vector ``[n, loss_sum, grad_sum...]`` per
  (partition, group); an exchange by group adds these vectors up, so no task
  holds a group's rows;
* the driver gets ``groups x parameters`` numbers back, applies Adam and
  broadcasts the new parameters for the next step.

Between rounds the ``fed`` groups of a seed are replaced by their
sample-weighted mean (``average_parameters`` is the same average as a Spark
operator over a table of vectors). The model is
``n_in -> 32 -> 16 -> 1`` with ReLU and a logistic output, trained with mean
binary cross-entropy and Adam (lr 0.01), one full-batch step per epoch; the
``fed`` clients restart Adam at every round.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.operators.metrics import PACKED

# Network shape and optimiser settings of the reference.
HIDDEN = (32, 16)
LEARNING_RATE = 0.01
BETAS = (0.9, 0.999)
EPS = 1e-8
#: Rows of a block, rows of a range of scores (about), and rows whose scores place the ranges (about).
BLOCK_ROWS = 1 << 14
RANGE_ROWS = 500_000
SAMPLE_ROWS = 10_000
_PACKED = pa.schema([("model", pa.string()), ("range", pa.int32()), ("score", pa.binary()), ("pos_of", pa.binary()),
                     ("neg_of", pa.binary()), ("pos", pa.int64()), ("neg", pa.int64())])


# ------------------------------------------------------------------ the network (NumPy helpers)
def shapes(n_in: int, hidden: Sequence[int] = HIDDEN) -> list[tuple[int, int]]:
    dims = [n_in, *hidden, 1]
    return [(dims[i + 1], dims[i]) for i in range(len(dims) - 1)]


def n_params(n_in: int, hidden: Sequence[int] = HIDDEN) -> int:
    return sum(o * i + o for o, i in shapes(n_in, hidden))


def init_params(n_in: int, seed: int, hidden: Sequence[int] = HIDDEN) -> np.ndarray:
    """Uniform(+-1/sqrt(fan_in)) weights and biases (the usual linear-layer default)."""
    rng = np.random.default_rng(seed)
    parts = []
    for o, i in shapes(n_in, hidden):
        bound = 1.0 / np.sqrt(i)
        parts += [rng.uniform(-bound, bound, o * i), rng.uniform(-bound, bound, o)]
    return np.concatenate(parts)


def unpack(theta: np.ndarray, n_in: int, hidden: Sequence[int] = HIDDEN) -> list[tuple[np.ndarray, np.ndarray]]:
    out, k = [], 0
    for o, i in shapes(n_in, hidden):
        w = theta[k:k + o * i].reshape(o, i)
        k += o * i
        b = theta[k:k + o]
        k += o
        out.append((w, b))
    return out


def logits(x: np.ndarray, theta: np.ndarray, n_in: int) -> np.ndarray:
    h = x
    layers = unpack(theta, n_in)
    for j, (w, b) in enumerate(layers):
        h = h @ w.T + b
        if j < len(layers) - 1:
            h = np.maximum(h, 0.0)
    return h[:, 0]


def loss_and_grad_sums(x: np.ndarray, y: np.ndarray, theta: np.ndarray, n_in: int) -> tuple[float, np.ndarray]:
    """Sum over rows of the binary cross-entropy with logits, and its gradient."""
    layers = unpack(theta, n_in)
    acts, pre = [x], []
    h = x
    for j, (w, b) in enumerate(layers):
        z = h @ w.T + b
        pre.append(z)
        h = np.maximum(z, 0.0) if j < len(layers) - 1 else z
        acts.append(h)
    z = pre[-1][:, 0]
    loss = float(np.sum(np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))))
    delta = (1.0 / (1.0 + np.exp(-z)) - y)[:, None]
    grads = []
    for j in range(len(layers) - 1, -1, -1):
        w, _ = layers[j]
        grads.append((delta.T @ acts[j], delta.sum(axis=0)))
        if j > 0:
            delta = (delta @ w) * (pre[j - 1] > 0)
    flat = []
    for gw, gb in reversed(grads):
        flat += [gw.ravel(), gb]
    return loss, np.concatenate(flat)


class Adam:
    def __init__(self, size: int):
        self.m = np.zeros(size)
        self.v = np.zeros(size)
        self.t = 0

    def step(self, theta: np.ndarray, grad: np.ndarray, lr: float = LEARNING_RATE) -> np.ndarray:
        self.t += 1
        b1, b2 = BETAS
        self.m = b1 * self.m + (1 - b1) * grad
        self.v = b2 * self.v + (1 - b2) * grad * grad
        mh = self.m / (1 - b1 ** self.t)
        vh = self.v / (1 - b2 ** self.t)
        return theta - lr * mh / (np.sqrt(vh) + EPS)


# ------------------------------------------------------------------ Spark side
_BLOCK = "groups array<string>, x binary, y binary"
_SUMS = "g string, v binary"


def blocks_of(rows: DataFrame, groups: str, features: str, label: str) -> DataFrame:
    """Rows (``groups`` array<string>, ``features`` array<double>, ``label``)
    packed into blocks of at most ``BLOCK_ROWS`` rows with equal groups."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False).astype("float64")
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(y), -1)
            key = pd.Series([tuple(g) for g in batch.column("g").to_pylist()], dtype=object)
            for g, at in key.groupby(key, sort=False).indices.items():
                parts = held.setdefault(g, [])
                parts.append((x[at], y[at]))
                if sum(len(q) for _, q in parts) >= BLOCK_ROWS:
                    yield from block(g, held.pop(g))
        for g, parts in held.items():
            yield from block(g, parts)

    def block(g: tuple, parts: list) -> Iterator[pa.RecordBatch]:
        x, y = (np.concatenate(z) for z in zip(*parts, strict=True))
        for lo in range(0, len(y), BLOCK_ROWS):
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(g)], pa.list_(pa.string())), pa.array([x[lo:lo + BLOCK_ROWS].tobytes()], pa.binary()),
                 pa.array([y[lo:lo + BLOCK_ROWS].tobytes()], pa.binary())], ["groups", "x", "y"])

    return rows.select(F.col(groups).alias("g"), F.col(features).alias("x"), F.col(label).cast("double").alias("y")
                       ).mapInArrow(pack, _BLOCK)


def _add_up(frame: pd.DataFrame) -> pd.DataFrame:
    # in the order of their bytes, so that reruns add up alike
    total = sum(np.frombuffer(v) for v in sorted(frame["v"]))
    return pd.DataFrame({"g": frame["g"].iloc[:1], "v": [total.tobytes()]})


def gradient_of_blocks(blocks: DataFrame, params: dict[str, np.ndarray], n_in: int
                       ) -> dict[str, tuple[float, float, np.ndarray]]:
    """Per group: (rows, loss sum, gradient sum) over all its blocks, for the
    group's current parameters. One Spark job."""
    b = blocks.sparkSession.sparkContext.broadcast(params)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[str, np.ndarray] = {}
        for batch in batches:
            for groups, x, y in zip(*(batch.column(c).to_pylist() for c in ("groups", "x", "y")), strict=True):
                x, y = np.frombuffer(x).reshape(-1, n_in), np.frombuffer(y)
                for g in groups:
                    if g is None:
                        continue
                    loss, grad = loss_and_grad_sums(x, y, b.value[g], n_in)
                    vec = np.concatenate([[len(y), loss], grad])
                    acc[g] = acc[g] + vec if g in acc else vec
        yield pa.RecordBatch.from_arrays([pa.array(list(acc), pa.string()),
                                          pa.array([v.tobytes() for v in acc.values()], pa.binary())], ["g", "v"])

    # groups x (parameters + 2) numbers: the model size, not the data size
    got = blocks.mapInArrow(partial, _SUMS).groupBy("g").applyInPandas(_add_up, _SUMS).collect()
    b.unpersist()
    sums = {r["g"]: np.frombuffer(r["v"]) for r in got}
    return {g: (v[0], v[1], v[2:]) for g, v in sums.items()}


def gradient_step(rows: DataFrame, group: str, features: str, label: str,
                  params: dict[str, np.ndarray], n_in: int) -> dict[str, tuple[float, float, np.ndarray]]:
    """``gradient_of_blocks`` for rows that are not packed: ``group`` string,
    ``features`` array<double>, ``label``."""
    return gradient_of_blocks(blocks_of(rows.withColumn("_g", F.array(group)), "_g", features, label), params, n_in)


def weighted_average(vectors: Sequence[np.ndarray], counts: Sequence[float]) -> np.ndarray:
    w = np.asarray(counts, dtype="float64")
    return np.tensordot(w / w.sum(), np.stack(vectors), axes=1)


def average_parameters(df: DataFrame, vector: str, count: str, by: Sequence[str] = ()) -> DataFrame:
    """Sample-weighted mean of parameter vectors per ``by`` group, as a Spark
    job: one row per (group, position), ``sum(w * n) / sum(n)``, gathered back
    into an array in position order."""
    by = list(by)
    long = df.select(*by, F.col(count).cast("double").alias("_n"), F.posexplode(vector).alias("_pos", "_w"))
    per = long.groupBy(*by, "_pos").agg((F.sum(F.col("_w") * F.col("_n")) / F.sum("_n")).alias("_avg"))
    return per.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_avg"))), lambda s: s["_avg"]).alias(vector))


def train_grouped(clients: DataFrame, features: Sequence[str], label: str, seeds: Sequence[int],
                  rounds: int = 15, epochs: int = 2, n_clients: int = 4) -> dict:
    """Centralised, local-only and averaged training for every seed in the
    same jobs. ``clients``: rows with ``seed``, ``client`` (0..n_clients-1),
    the (standardised) ``features`` and ``label``. Returns final parameters per
    group, the averaged model after every round per seed, and client sizes."""
    n_in = len(features)
    size = n_params(n_in)
    feats = F.array(*[F.col(c).cast("double") for c in features])
    sid = F.col("seed").cast("string")
    member = F.array(F.concat(sid, F.lit("|central|0")),
                     F.concat(sid, F.lit("|local|"), F.col("client").cast("string")),
                     F.concat(sid, F.lit("|fed|"), F.col("client").cast("string")))
    from vitalgrid.session import materialize
    rows = clients.select(member.alias("groups"), feats.alias("x"), F.col(label).cast("double").alias("y"))
    spread = clients.sparkSession.sparkContext.defaultParallelism
    blocks = materialize(blocks_of(rows, "groups", "x", "y").repartition(spread), "grouped-blocks")
    size_of = F.length("y") / 8
    counts = {r["group"]: int(r["count"]) for r in blocks.select(F.explode("groups").alias("group"), size_of.alias("n"))
              .groupBy("group").agg(F.sum("n").alias("count")).collect()}

    params, opt = {}, {}
    for s in seeds:
        start = init_params(n_in, s)
        params[f"{s}|central|0"] = start.copy()
        opt[f"{s}|central|0"] = Adam(size)
        for c in range(n_clients):
            params[f"{s}|local|{c}"] = start.copy()
            opt[f"{s}|local|{c}"] = Adam(size)
            params[f"{s}|fed|{c}"] = start.copy()
    glob = {s: init_params(n_in, s) for s in seeds}
    history: dict[int, list[np.ndarray]] = {s: [] for s in seeds}
    params = {g: p for g, p in params.items() if g in counts}
    for r in range(rounds):
        for s in seeds:                      # every round: clients restart from the averaged model
            for c in range(n_clients):
                g = f"{s}|fed|{c}"
                if g in params:
                    params[g] = glob[s].copy()
                    opt[g] = Adam(size)
        for _ in range(epochs):
            sums = gradient_of_blocks(blocks, params, n_in)
            for g, (n, _, grad) in sums.items():
                params[g] = opt[g].step(params[g], grad / n)
        for s in seeds:
            gs = [f"{s}|fed|{c}" for c in range(n_clients) if f"{s}|fed|{c}" in params]
            glob[s] = weighted_average([params[g] for g in gs], [counts[g] for g in gs])
            history[s].append(glob[s].copy())
    return {"params": params, "global": glob, "history": history, "counts": counts, "n_in": n_in}


def _probability(x: np.ndarray, theta: np.ndarray, n_in: int) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-logits(x, theta, n_in)))


def score_models(df: DataFrame, features: Sequence[str], models: dict[str, np.ndarray], n_in: int,
                 keep: Sequence[str] = (), packed_for: str | None = None) -> DataFrame:
    """Long table ``model, score (probability), keep...`` for every model and
    row, scored in one Arrow pass (all models per batch). With ``packed_for`` a
    label: packed scores for ``metrics.model_table`` (``pack_scores``)."""
    if packed_for is not None:
        return pack_scores(df, features, models, n_in, packed_for)
    names = list(models)
    b = df.sparkSession.sparkContext.broadcast([models[m] for m in names])

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def all_scores(x: pd.Series) -> pd.Series:
        mat = np.stack(x.to_numpy()).astype("float64")
        out = np.stack([_probability(mat, th, n_in) for th in b.value], axis=1)
        return pd.Series(list(out))

    feats = F.array(*[F.col(c).cast("double") for c in features])
    scored = df.select(*keep, all_scores(feats).alias("_s"))
    idx = F.array(*[F.lit(m) for m in names])
    return scored.select(*keep, F.posexplode("_s").alias("_i", "score")).select(
        *keep, F.element_at(idx, F.col("_i") + 1).alias("model"), "score")


def pack_scores(df: DataFrame, features: Sequence[str], models: dict[str, np.ndarray], n_in: int, label: str,
                range_rows: int = RANGE_ROWS) -> DataFrame:
    """The scores of ``score_models`` packed (``metrics.PACKED``) for ``metrics.model_table``: no row per model and row.

    Every task scores its rows by all models and writes, per model and range of
    scores, the distinct scores with their positives and negatives as arrays.
    Ranges hold about ``range_rows`` rows by the quantiles of a sample, which
    decide no result. Rows without a label count nowhere; a score that is no number raises."""
    names, thetas = list(models), list(models.values())
    feats = F.array(*[F.col(c).cast("double") for c in features])
    rows = df.select(feats.alias("x"), F.col(label).cast("double").alias("y"))
    ranges = max(1, -(-df.count() // range_rows))
    bounds = [np.empty(0)] * len(names)
    if ranges > 1:
        few = rows.filter(F.pmod(F.xxhash64("x"), F.lit(ranges * range_rows)) < SAMPLE_ROWS).limit(2 * SAMPLE_ROWS).collect()
        if few:
            x = np.array([r["x"] for r in few], dtype="float64")
            bounds = [np.unique(np.quantile(_probability(x, th, n_in), np.arange(1, ranges) / ranges)) for th in thetas]
    b = df.sparkSession.sparkContext.broadcast((thetas, bounds))

    def told(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        x, y = (np.concatenate(z) for z in zip(*held, strict=True))
        known = ~np.isnan(y)
        y = y[known]
        for name, theta, at in zip(names, *b.value, strict=True):
            p = _probability(x, theta, n_in)
            if np.isnan(p).any():
                raise ValueError(f"NULL in the scores of {name}")
            s, place = np.unique(p[known], return_inverse=True)
            pos = np.bincount(place, weights=y, minlength=len(s)).astype(np.uint32)
            neg = np.bincount(place, minlength=len(s)).astype(np.uint32) - pos
            cut = [0, *np.searchsorted(s, at, side="left").tolist(), len(s)]
            yield pa.RecordBatch.from_pylist(
                [{"model": name, "range": k, "score": s[i:j].tobytes(), "pos_of": pos[i:j].tobytes(),
                  "neg_of": neg[i:j].tobytes(), "pos": int(pos[i:j].sum()), "neg": int(neg[i:j].sum())}
                 for k, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if j > i], schema=_PACKED)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False).astype("float64")
            held.append((batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), n_in), y))
            size += len(y)
            if size >= BLOCK_ROWS:
                yield from told(held)
                held, size = [], 0
        if size:
            yield from told(held)

    return rows.mapInArrow(score, PACKED)
