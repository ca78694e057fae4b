"""Embedding near-duplicates: spherical k-means cells, blocked cosine products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.components import connected_components
from vitalgrid.session import materialize

#: Vectors a cell should hold, cells in all (bounds the broadcast centroids), vectors of a label that k-means sees.
CELL_VECTORS = 1024
MAX_CELLS = 8192
FIT_VECTORS = 20_000
FIT_ROUNDS = 8
#: Vectors of one block; a pair of blocks is one unit of work.
BLOCK = 4096
#: Rows of a product computed at a time.
STRIP = 512


def _unit(vectors: list, dim: int) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64).reshape(len(vectors), dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = FIT_ROUNDS, seed: int = 42) -> np.ndarray:
    """Unit centroids of ``k`` cells of unit vectors (empty cells keep their centroid)."""
    pick = np.random.default_rng(seed).choice(len(x), size=min(k, len(x)), replace=False)
    c = x[np.sort(pick)].copy()
    for _ in range(rounds):
        home = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1)
        ok = norm > 1e-12
        c[ok] = total[ok] / norm[ok, None]
    return c


def _fit(goal: dict):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep")
        label, dim = int(frame["label"].iloc[0]), int(frame["dim"].iloc[0])
        c = spherical_kmeans(_unit(frame["vec"].tolist(), dim), goal[label, dim])
        return pd.DataFrame({"label": label, "dim": dim, "centroids": [c.astype("<f8").tobytes()]})

    return run


def _assign(shared, blocks: dict, reach: float):
    """Home cell of every vector, and the further cells in which a vector
    within ``reach`` (Euclidean, of unit vectors) of it can live: y is at home
    in cell c only if y . (h - c) <= 0, so x must have x . (h - c) <= reach |h - c|.
    Only cells numbered above the home cell are visited, so that a pair is
    compared in one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        norms: dict[tuple[int, int], np.ndarray] = {}  # |c|^2 of a label's centroids
        for batch in batches:
            label, dim = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
            rep, vec = batch.column("rep").to_numpy(), batch.column("vec")
            src: list[np.ndarray] = []
            cell: list[np.ndarray] = []
            home_row: list[np.ndarray] = []
            for key in sorted(set(zip(label.tolist(), dim.tolist(), strict=True))):
                at = np.flatnonzero((label == key[0]) & (dim == key[1]))
                c = centroids.get(key)
                if c is None:
                    src.append(at)
                    cell.append(np.zeros(len(at), np.int64))
                    home_row.append(np.ones(len(at), bool))
                    continue
                x = _unit(vec.take(pa.array(at)).to_pylist(), key[1])
                if key not in norms:
                    norms[key] = (c * c).sum(axis=1)
                # rows in strips, so that strip x cells numbers are held at a time, never cells x cells
                for lo in range(0, len(at), STRIP):
                    near = x[lo:lo + STRIP] @ c.T
                    home = np.argmax(near, axis=1)
                    gap = np.sqrt(np.maximum(0.0, norms[key][home][:, None] + norms[key] - 2 * (c[home] @ c.T)))
                    visit = near[np.arange(len(near)), home][:, None] - near <= reach * gap + 1e-9
                    visit &= np.arange(len(c))[None, :] >= home[:, None]
                    r, k = np.nonzero(visit)
                    src.append(at[lo:lo + STRIP][r])
                    cell.append(k)
                    home_row.append(k == home[r])
            if not src:
                continue
            s, k, h = np.concatenate(src), np.concatenate(cell), np.concatenate(home_row)
            take = pa.array(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(label[s], pa.int64()), pa.array(dim[s], pa.int32()), pa.array(k, pa.int64()),
                 pa.array(h, pa.bool_()), pa.array(rep[s], pa.int64()), batch.column("copies").take(take),
                 vec.take(take)], ["label", "dim", "cell", "home", "rep", "copies", "vec"])

    return run


def block_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Strips (first row, rows, columns) of the pairs of ``x`` and ``y`` with a
    cosine of ``threshold`` or more; within one block only row < column."""
    for lo in range(0, len(x), STRIP):
        hit = x[lo:lo + STRIP] @ y.T >= threshold
        if same:
            hit &= np.arange(len(y))[None, :] > np.arange(lo, lo + len(hit))[:, None]
        r, c = np.nonzero(hit)
        yield lo, r + lo, c


def _compare(threshold: float):
    """One pair of blocks of a cell: links per vector (copies counted) and for
    each vector the vector its links inside this unit of work lead to, so that
    no more rows leave than came in, however many pairs are linked."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["side", "rep"], ignore_index=True)
        dim = int(frame["dim"].iloc[0])
        x = _unit(frame["vec"].tolist(), dim)
        side, home = frame["side"].to_numpy(), frame["home"].to_numpy(bool)
        copies, rep = frame["copies"].to_numpy(np.int64), frame["rep"].to_numpy(np.int64)
        links, root = np.zeros(len(x), np.int64), np.arange(len(x))

        def join(rows: np.ndarray, cols: np.ndarray) -> None:
            # copies are weighted with numpy's unbuffered adds; roots are merged until nothing changes
            np.add.at(links, rows, copies[cols])
            np.add.at(links, cols, copies[rows])
            while len(rows):
                a, b = root[rows], root[cols]
                open_ = a != b
                if not open_.any():
                    break
                rows, cols, a, b = rows[open_], cols[open_], a[open_], b[open_]
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                while True:
                    up = root[root]
                    if (up == root).all():
                        break
                    root[:] = up

        # side 0 with itself (a diagonal unit), or side 0 with side 1; two visitors are never compared here
        first = np.flatnonzero(side == 0)
        second = np.flatnonzero(side == 1)
        if not len(second):
            at_home, visit = first[home[first]], first[~home[first]]
            for _, r, c in block_links(x[at_home], x[at_home], threshold, True):
                join(at_home[r], at_home[c])
            for _, r, c in block_links(x[at_home], x[visit], threshold, False):
                join(at_home[r], visit[c])
        else:
            for a, b in ((first[home[first]], second), (first[~home[first]], second[home[second]])):
                for _, r, c in block_links(x[a], x[b], threshold, False):
                    join(a[r], b[c])
        some = links > 0
        return pd.DataFrame({"rep": rep[some], "links": links[some], "to": rep[root[some]]})

    return run


def embedding_groups(vectors: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding",
                     label: str = "label", cell_vectors: int = CELL_VECTORS, fit_vectors: int = FIT_VECTORS,
                     block: int = BLOCK) -> DataFrame:
    """Vectors of one label linked by a cosine (double precision) of at least ``threshold``.

    Equal vectors of a label are put together first and carry their number of
    copies. A label with more than ``cell_vectors`` different vectors is cut
    into cells by spherical k-means, fitted on at most about ``fit_vectors`` of
    them chosen by hash; every vector goes to its home cell, and visits each
    other cell in which a vector within the threshold can be at home. This is a
    geometric bound, so no link is missed whatever the fit. Cells are cut into
    blocks, and the cosines of each pair of blocks are a matrix product; a unit
    of work returns link counts and one edge per vector, never pairs.

    Returns one row per input row: ``vec_id, n_links`` (other vectors linked
    directly), ``component_id`` (smallest identifier reachable, itself
    included), ``kept`` (``vec_id = component_id``). A vector that is null,
    empty, zero or holds a null or non-finite component, or whose label or
    identifier is null, links with nothing. Vectors of different lengths are
    never linked. Repeated rows are copies of each other: they count as links.
    An empty table gives an empty result; other columns are ignored.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    spark = vectors.sparkSession
    v = F.col(vector).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = (F.col(vec_id).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & ~odd
              & F.exists(v, lambda x: x != 0))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                          v.alias("vec"), F.coalesce(usable, F.lit(False)).alias("usable"))
    one = materialize(rows.filter("usable").groupBy("label", "vec").agg(F.min("vec_id").alias("rep"),
                                                                        F.count("*").alias("copies"))
                      .withColumn("dim", F.size("vec")), "emb-vectors")
    sizes = one.groupBy("label", "dim").agg(F.count("*").alias("n"))
    total, widest = one.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    # cells of at least cell_vectors, and at most MAX_CELLS (or 64 MB of centroids) in all, so the broadcast is bounded
    per_cell = max(cell_vectors, -(-total // min(MAX_CELLS, max(1, (64 << 20) // (8 * widest)))))
    large = sizes.filter(F.col("n") > per_cell).collect()
    goal = {(r["label"], r["dim"]): -(-r["n"] // per_cell) for r in large}
    centroids = {}
    if goal:
        chance = F.pmod(F.xxhash64(F.lit("fit"), "rep"), F.lit(1_000_003)) / 1_000_003
        sample = one.join(F.broadcast(spark.createDataFrame(
            [(k[0], k[1], min(1.0, fit_vectors / r["n"])) for k, r in zip(goal, large, strict=True)],
            "label long, dim int, share double")), ["label", "dim"]).filter(chance < F.col("share"))
        got = sample.select("label", "dim", "rep", "vec").groupBy("label", "dim").applyInPandas(
            _fit(goal), "label long, dim int, centroids binary").collect()
        centroids = {(r["label"], r["dim"]): np.frombuffer(r["centroids"], "<f8").reshape(-1, r["dim"]) for r in got}
    shared = spark.sparkContext.broadcast(centroids)
    reach = float(np.sqrt(2 - 2 * threshold))
    kind = "label long, dim int, cell long, home boolean, rep long, copies long, vec array<double>"
    placed = materialize(one.select("label", "dim", "rep", "copies", "vec")
                         .mapInArrow(_assign(shared, {}, reach), kind), "emb-cells")
    # blocks per cell from its number of rows; one row per cell, joined by its size
    cells = materialize(placed.groupBy("label", "dim", "cell").agg(
        F.ceil(F.count("*") / block).cast("int").alias("blocks")), "emb-blocks")
    n = F.col("blocks")
    mine = F.pmod(F.xxhash64("rep"), n.cast("long")).cast("int")
    dealt = placed.join(cells, ["label", "dim", "cell"]).withColumn("mine", mine)
    other = F.explode(F.sequence(F.lit(0), n - 1))
    dealt = dealt.withColumn("other", other)
    units = dealt.select("label", "dim", "cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
                         F.when(F.col("mine") > F.col("other"), 1).otherwise(0).alias("side"),
                         "home", "rep", "copies", "vec")
    found = materialize(units.groupBy("label", "dim", "cell", "i", "j").applyInPandas(
        _compare(threshold), "rep long, links long, to long"), "emb-links")
    groups = connected_components(found.select("rep", "to"), "rep", "to")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = materialize(links.join(groups, links["rep"] == groups["node"], "left")
                        .select("rep", "links", F.coalesce("component", "rep").alias("component")), "emb-named")
    per_vec = one.select("label", "vec", "rep", "copies").join(named, "rep", "left")
    told = per_vec.select("label", "vec", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
                          F.coalesce("component", "rep").alias("component"))
    good = rows.filter("usable").join(told, ["label", "vec"]).select("vec_id", "links", "component")
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))
    out = good.union(alone).toDF("vec_id", "n_links", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
