"""Product codes of vectors: integer k-means per part over metric trees built by the anchors hierarchy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.workers import tidy
from vitalgrid.session import materialize

#: Components of the vectors of one block (a set of trees), and points of a leaf.
BLOCK_COMPONENTS = 1 << 18
LEAF = 32
#: Bound of the integer components, so that squared distances fit 64 bits.
MAX_COMPONENT = 1 << 26


def anchors(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to ``k`` anchors of the points ``x``: (owner of each point, squared
    distance to it, anchor points). The next anchor is the point farthest from
    its own one; it takes the points that are nearer to it, and only points
    farther from their anchor than half the anchors' distance are asked."""
    centre = x[:1]
    d2 = ((x - centre) ** 2).sum(axis=1)
    owner = np.zeros(len(x), np.int64)
    while len(centre) < k:
        far = int(np.argmax(d2))
        if not d2[far]:
            break  # all points sit on their anchors
        new = x[far]
        ask = np.flatnonzero(4 * d2 > ((centre - new) ** 2).sum(axis=1)[owner])
        to_new = ((x[ask] - new) ** 2).sum(axis=1)
        nearer = to_new < d2[ask]
        owner[ask[nearer]], d2[ask[nearer]] = len(centre), to_new[nearer]
        centre = np.vstack([centre, new])
    return owner, d2, centre


class Tree:
    """A metric tree of integer points, built middle-out: about sqrt(n) anchors,
    joined pair by pair (smallest joint ball first) up to the root, and each of
    them built in the same way below, down to ``LEAF`` points. Points are put in
    ``order`` so that a ball is the range ``lo:hi``; every ball caches the sums
    of its points, and the squared radius about their floored mean."""

    def __init__(self, x: np.ndarray):
        self.children: list[tuple[int, int]] = []
        self.items: list[np.ndarray | None] = []
        root = self._build(x, np.arange(len(x)))
        n = len(self.children)
        self.lo, self.hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
        order, at, stack = [], 0, [(root, False)]
        while stack:
            node, closed = stack.pop()
            if closed:
                self.hi[node] = at
                continue
            self.lo[node] = at
            stack.append((node, True))
            if self.items[node] is None:
                stack.extend((child, False) for child in reversed(self.children[node]))
            else:
                order.append(self.items[node])
                at += len(self.items[node])
        self.order = np.concatenate(order)
        self.left, self.right = np.array(self.children, np.int64).T
        x = x[self.order]
        upto = np.vstack([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x, axis=0)])
        self.sums = upto[self.hi] - upto[self.lo]
        size = self.hi - self.lo
        node, point = np.repeat(np.arange(n), size), ranges(self.lo, size)
        d2 = ((x[point] - (self.sums // size[:, None])[node]) ** 2).sum(axis=1)
        self.radius2 = np.maximum.reduceat(d2, np.cumsum(size) - size)

    def _add(self, children: tuple[int, int], items: np.ndarray | None) -> int:
        self.children.append(children)
        self.items.append(items)
        return len(self.items) - 1

    def _build(self, x: np.ndarray, items: np.ndarray) -> int:
        if len(items) <= LEAF:
            return self._add((-1, -1), items)
        own = x[items]
        owner, d2, centre = anchors(own, int(np.ceil(np.sqrt(len(items)))))
        if len(centre) == 1:
            return self._add((-1, -1), items)  # equal points
        by = np.argsort(owner, kind="stable")
        starts = np.searchsorted(owner[by], np.arange(len(centre)))
        radius = np.sqrt(np.maximum.reduceat(d2[by], starts).astype(float))
        nodes = [self._build(x, items[some]) for some in np.split(by, starts[1:])]
        middle = centre.astype(float)
        joint = np.sqrt(((middle[:, None] - middle) ** 2).sum(axis=2)) + radius[:, None] + radius
        np.fill_diagonal(joint, np.inf)
        weight = np.diff(starts, append=len(by)).astype(float)
        for _ in range(len(nodes) - 1):
            a, b = divmod(int(np.argmin(joint)), len(nodes))
            nodes[a] = self._add((nodes[a], nodes[b]), None)
            mean = (weight[a] * middle[a] + weight[b] * middle[b]) / (weight[a] + weight[b])
            radius[a] = max(np.linalg.norm(middle[a] - mean) + radius[a], np.linalg.norm(middle[b] - mean) + radius[b])
            middle[a], weight[a] = mean, weight[a] + weight[b]
            gone = np.isinf(joint[a])
            joint[a] = np.sqrt(((middle - mean) ** 2).sum(axis=1)) + radius + radius[a]
            joint[a, gone] = joint[a, b] = np.inf
            joint[:, a] = joint[a]
            joint[b] = joint[:, b] = np.inf
        return nodes[a]


def ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers lo .. lo + size - 1 of every range, one after the other."""
    return np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())


def owners(tree: Tree, x: np.ndarray, book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Nearest entry (ties: the lower index) of all points ``x`` (in tree order).

    A ball goes down with the entries that may own a point of it. The entry
    nearest to its middle beats another one on the whole ball if the difference
    of their squared distances there exceeds twice the radius times the
    distance of both. Yields (balls, entries, None) for balls that one entry
    owns, and (points, entries, squared distances) for points of other leaves."""
    norm = np.sqrt(((book[:, None] - book).astype(float) ** 2).sum(axis=2))
    first = np.array([not (book[:i] == e).all(axis=1).any() for i, e in enumerate(book)])  # an equal entry never wins
    size = tree.hi - tree.lo
    balls, may = np.array([len(size) - 1]), first[None, :]
    while len(balls):
        d2 = ((tree.sums[balls] // size[balls, None])[:, None] - book) ** 2
        d2 = np.where(may, d2.sum(axis=2), np.iinfo(np.int64).max)
        best = np.argmin(d2, axis=1)
        ahead = (d2 - d2[np.arange(len(best)), best][:, None]).astype(float)
        reach = 2 * np.sqrt(tree.radius2[balls].astype(float))[:, None] * norm[best]
        may = may & (ahead <= reach * (1 + 1e-9) + 1e-3)
        owned = may.sum(axis=1) == 1
        yield balls[owned], best[owned], None
        leaf = ~owned & (tree.left[balls] < 0)
        if leaf.any():
            n = size[balls[leaf]]
            points = ranges(tree.lo[balls[leaf]], n)
            row, entry = np.nonzero(np.repeat(may[leaf], n, axis=0))
            far = ((x[points[row]] - book[entry]) ** 2).sum(axis=1)
            starts = np.searchsorted(row, np.arange(len(points)))
            least = np.minimum.reduceat(far, starts)
            hit = np.flatnonzero(far == least[row])
            yield points, entry[hit[np.searchsorted(row[hit], np.arange(len(points)))]], least
        down = ~owned & ~leaf
        balls, may = np.concatenate([tree.left[balls[down]], tree.right[balls[down]]]), np.tile(may[down], (2, 1))


class _Stored(Tree):
    """A tree read back from the table."""

    def __init__(self, nodes: np.ndarray, sums: np.ndarray, radius2: np.ndarray):
        self.lo, self.hi, self.left, self.right = nodes
        self.sums, self.radius2 = sums, radius2


_TREES = "points binary, orders binary, sizes array<int>, nodes binary, sums binary, radii binary"


def _build_trees(parts: int, width: int, block: int):
    def emit(ids: pa.Array, labels: pa.Array, flat: np.ndarray) -> pa.RecordBatch:
        x = flat.reshape(len(ids), parts, width)
        trees = [Tree(x[:, p]) for p in range(parts)]
        raw = [flat.astype("<i4"), np.concatenate([t.order for t in trees]).astype("<i4"),
               np.concatenate([np.stack([t.lo, t.hi, t.left, t.right]).ravel() for t in trees]).astype("<i4"),
               np.concatenate([t.sums.ravel() for t in trees]), np.concatenate([t.radius2 for t in trees])]
        points, orders, nodes, sums, radii = [pa.array([r.tobytes()], pa.binary()) for r in raw]
        whole = pa.array([0, len(ids)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(whole, ids), pa.ListArray.from_arrays(whole, labels), points, orders,
             pa.array([[len(t.lo) for t in trees]], pa.list_(pa.int32())), nodes, sums, radii],
            ["ids", "labels", "points", "orders", "sizes", "nodes", "sums", "radii"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def blocks(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            if count < least or not count:
                return
            rows = pa.Table.from_batches(held).combine_chunks()
            ids, labels, parts_ = (c.chunk(0) for c in (rows["_id"], rows["_label"], rows["_parts"]))
            flat = parts_.flatten().to_numpy().reshape(count, parts * width)
            at = 0
            while count - at >= least and at < count:
                n = min(block, count - at)
                yield emit(ids.slice(at, n), labels.slice(at, n), flat[at:at + n])
                at += n
            held, count = [b for b in rows.slice(at).to_batches() if b.num_rows], count - at

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            yield from blocks(block)
        yield from blocks(1)

    return run


def _read(batch: pa.RecordBatch, row: int, parts: int, width: int):
    """Trees of a block, each with its points in tree order and their places in the block."""
    raw = [np.frombuffer(batch.column(c)[row].as_py(), kind).astype(np.int64) for c, kind in
           (("points", "<i4"), ("orders", "<i4"), ("nodes", "<i4"), ("sums", "<i8"), ("radii", "<i8"))]
    points, orders, nodes, sums, radii = raw
    points, orders = points.reshape(-1, parts, width), orders.reshape(parts, -1)
    at = 0
    for p, n in enumerate(batch.column("sizes")[row].as_py()):
        tree = _Stored(nodes[4 * at:4 * (at + n)].reshape(4, n), sums[at * width:(at + n) * width].reshape(n, width),
                       radii[at:at + n])
        yield p, tree, points[orders[p], p], orders[p]
        at += n


def _totals(books: np.ndarray):
    """Sums and counts of every entry over the blocks of a task."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                for p, tree, x, _ in _read(batch, row, parts, width):
                    for what, entry, least in owners(tree, x, books[p]):
                        if least is None:
                            add = np.column_stack([tree.sums[what], tree.hi[what] - tree.lo[what]])
                        else:
                            add = np.column_stack([x[what], np.ones(len(what), np.int64)])
                        np.add.at(total[p], entry, add)
        p, e, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(j), pa.array(total[p, e, j])],
                                         ["part", "entry", "place", "total"])

    return run


def _assign(books: np.ndarray):
    """Code and error of every vector."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels = batch.column("ids")[row].values, batch.column("labels")[row].values
                code, error = np.zeros((len(ids), parts), np.int32), np.zeros(len(ids), np.int64)
                for p, tree, x, order in _read(batch, row, parts, width):
                    mine, far = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                    for what, entry, least in owners(tree, x, books[p]):
                        if least is None:
                            size = tree.hi[what] - tree.lo[what]
                            what, entry = ranges(tree.lo[what], size), np.repeat(entry, size)
                            least = ((x[what] - books[p][entry]) ** 2).sum(axis=1)
                        mine[what], far[what] = entry, least
                    code[order, p] = mine
                    error[order] += far
                codes = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * parts, pa.int32()), code.ravel())
                yield pa.RecordBatch.from_arrays([ids, labels, codes, pa.array(error)], ["_id", "_label", "codes", "error"])

    return run


def finite(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd, F.lit(False))


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
             vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
             block: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """Vectors as codes of ``parts`` entry numbers, with the codebooks they refer to.

    Components become integers floor(scale * x), and a vector is cut into
    ``parts`` equal consecutive parts (a length that ``parts`` does not divide
    is filled up with zeros). The codebook of a part position starts as that
    part of the ``entries`` smallest identifiers (ties by vector); each round
    assigns every part to the nearest entry (squared Euclidean distance, ties to
    the lower index) and puts the floored mean of its parts in an entry's place;
    entries without a part stay. Everything is exact integer arithmetic.

    Blocks of at most ``block`` vectors (as they come, no shuffle) get one
    metric tree per part position, built once by the anchors hierarchy and
    written to the shared folder. A round sends the codebooks down the trees:
    balls that one entry owns add their cached sums and counts, and only sums
    per entry leave a task, so the driver gets parts x entries x width numbers.

    Returns ``vec_id, label, codes`` (array of int), ``error`` (long, summed
    over the parts) per kept row, and the codebooks (parts, entries, width).
    Rows whose vector is null, empty, holds a null or non-finite component, or
    has another length than that of the smallest kept identifier are dropped.
    Null identifiers come last and are kept, as are repeated rows; fewer than
    ``entries`` rows give fewer entries; an empty table gives no rows and empty
    codebooks. Components of 2^26 or more after scaling raise. Other columns are
    ignored, whatever their names.
    """
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).alias("_id"), F.col(label).alias("_label"), v.alias("_v")).filter(
        finite(F.col("_v")) & (F.size("_v") > 0))
    spark = vectors.sparkSession
    kinds = [rows.schema[c].dataType.simpleString() for c in ("_id", "_label")]
    first = rows.orderBy(F.col("_id").asc_nulls_last(), "_v").limit(1).first()
    kept_kind = f"_id {kinds[0]}, _label {kinds[1]}, codes array<int>, error long"
    if first is None:
        empty = spark.createDataFrame([], kept_kind)
        return empty.withColumnsRenamed({"_id": vec_id, "_label": label}), np.zeros((parts, 0, 0), np.int64)
    dim = len(first["_v"])
    width = -(-dim // parts)
    whole = F.transform("_v", lambda x: F.when(F.abs(x * scale) < MAX_COMPONENT, F.floor(x * scale)).otherwise(
        F.raise_error(F.lit("a component is too large for integer codes")).cast("long")).cast("int"))
    padded = F.concat(whole, F.array_repeat(F.lit(0), parts * width - dim)) if dim % parts else whole
    ints = rows.filter(F.size("_v") == dim).select("_id", "_label", padded.alias("_parts"))
    start = rows.filter(F.size("_v") == dim).orderBy(F.col("_id").asc_nulls_last(), "_v").limit(entries).select(
        padded.alias("_parts")).collect()
    books = np.array([r["_parts"] for r in start], np.int64).reshape(len(start), parts, width).swapaxes(0, 1)
    block = block or max(LEAF, BLOCK_COMPONENTS // (parts * width))
    trees = materialize(ints.mapInArrow(tidy(_build_trees(parts, width, block)),
                                        f"ids array<{kinds[0]}>, labels array<{kinds[1]}>, {_TREES}"), "vector-trees")
    for _ in range(rounds):
        got = trees.mapInArrow(tidy(_totals(books)), "part long, entry long, place long, total long").groupBy(
            "part", "entry", "place").agg(F.sum("total").alias("total")).collect()
        total = np.zeros((parts, books.shape[1], width + 1), np.int64)
        for r in got:
            total[r["part"], r["entry"], r["place"]] = r["total"]
        used = total[:, :, width] > 0
        books = books.copy()
        books[used] = total[used][:, :width] // total[used][:, width:]
    kept = trees.mapInArrow(tidy(_assign(books)), kept_kind)
    return kept.withColumnsRenamed({"_id": vec_id, "_label": label}), books
