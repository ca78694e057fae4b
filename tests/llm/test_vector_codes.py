"""Integer product codes against plain k-means, and the trees' invariants."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalgrid.llm.queries import QUERIES
from vitalgrid.llm.vector_codes import LEAF, Tree, compress, owners


def plain(ids, x, parts=8, entries=16, rounds=6):
    """Codes, errors and codebooks by distances of all points to all entries."""
    x = x[np.argsort(ids, kind="stable")]
    cut = x.reshape(len(x), parts, -1)
    books = cut[:entries].swapaxes(0, 1).copy()
    for turn in range(rounds + 1):
        d = ((cut[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        code = d.argmin(axis=2)
        if turn == rounds:
            return code, d.min(axis=2).sum(axis=1), books
        for p in range(parts):
            for e in range(books.shape[1]):
                if (code[:, p] == e).any():
                    books[p, e] = cut[code[:, p] == e, p].sum(axis=0) // (code[:, p] == e).sum()


def groups(n, dim, spread, seed=0):
    draw = np.random.default_rng(seed)
    return draw.normal(size=(12, dim))[draw.integers(0, 12, n)] + spread * draw.normal(size=(n, dim))


@pytest.mark.parametrize("spread", [0.02, 0.5])
def test_against_plain_kmeans(spark, spread):
    x = groups(1500, 32, spread)
    x[700:760] = x[3]
    rows = [(int(i) * 3, [float(a) for a in v], int(i) % 4) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    kept, books = compress(df, block=400)
    code, error, want = plain(np.arange(len(x)), np.floor(4096 * x).astype(np.int64))
    got = sorted(kept.collect())
    assert (books == want).all()
    assert [r["codes"] for r in got] == code.tolist() and [r["error"] for r in got] == error.tolist()


def test_tree_is_a_partition_and_caches_are_true():
    x = np.floor(4096 * groups(3000, 8, 0.3)).astype(np.int64)
    x[100:400] = x[7]
    tree = Tree(x)
    assert sorted(tree.order) == list(range(len(x)))
    y = x[tree.order]
    root = len(tree.lo) - 1
    assert (tree.lo[root], tree.hi[root]) == (0, len(x))
    for i in range(len(tree.lo)):
        own = y[tree.lo[i]:tree.hi[i]]
        assert (own.sum(axis=0) == tree.sums[i]).all()
        assert ((own - tree.sums[i] // len(own)) ** 2).sum(axis=1).max() == tree.radius2[i]
        if tree.left[i] >= 0:
            a, b = tree.left[i], tree.right[i]
            assert (tree.lo[a], tree.hi[a], tree.hi[b]) == (tree.lo[i], tree.lo[b], tree.hi[i])
        else:
            assert len(own) <= LEAF or (own == own[0]).all()


def test_owned_balls_spare_points():
    """On well separated groups nearly all points are met as parts of owned balls."""
    x = np.floor(4096 * groups(4000, 8, 0.01)).astype(np.int64)
    tree = Tree(x)
    y = x[tree.order]
    book = np.unique(np.floor(4096 * groups(400, 8, 0.0)).astype(np.int64), axis=0)
    seen, single = np.zeros(len(x), int), 0
    for what, entry, least in owners(tree, y, book):
        if least is None:
            for ball, e in zip(what, entry, strict=True):
                seen[tree.lo[ball]:tree.hi[ball]] += 1
                d = ((y[tree.lo[ball]:tree.hi[ball], None] - book) ** 2).sum(axis=2)
                assert (d.argmin(axis=1) == e).all()
        else:
            single += len(what)
            seen[what] += 1
    assert (seen == 1).all() and single < len(x) / 20


def test_ties_go_to_the_lower_entry():
    x = np.array([[0, 0], [2, 0], [1, 0], [1, 5], [2, 0]] * 20, np.int64)
    tree = Tree(x)
    y, book = x[tree.order], np.array([[2, 0], [0, 0], [2, 0]], np.int64)
    code = np.full(len(x), -1)
    for what, entry, least in owners(tree, y, book):
        for w, e in zip(what, entry, strict=True):
            code[w if least is not None else slice(tree.lo[w], tree.hi[w])] = e
    assert (code == ((y[:, None] - book) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_edges(spark):
    kind = "vec_id long, embedding array<float>, label string"
    rows = [(5, [0.5] * 10, "a"), (5, [0.5] * 10, "a"), (2, [0.25] * 9 + [-0.1], None), (None, [1.0] * 10, None),
            (1, None, "a"), (3, [], "a"), (4, [1.0] * 9 + [None], "a"), (6, [float("nan")] * 10, "b"),
            (7, [float("inf")] * 10, "b"), (8, [1.0] * 4, "b")]
    df = spark.createDataFrame(rows, kind)
    df = df.select("*", *[F.lit("clash").alias(c) for c in ("codes", "error", "_id", "_v", "ids", "entry")])
    kept, books = compress(df)
    got = sorted(((r["vec_id"] or 99), r["codes"], r["error"]) for r in kept.collect())
    assert [g[0] for g in got] == [2, 5, 5, 99] and books.shape == (8, 4, 2)
    assert got[1] == got[2] and all(g[2] >= 0 for g in got)
    assert books[4].tolist()[0] == [1024, -410] and books[7].tolist()[0] == [0, 0]
    none, empty = compress(df.limit(0))
    assert none.count() == 0 and none.columns == ["vec_id", "label", "codes", "error"] and empty.size == 0
    with pytest.raises(Exception, match="too large"):
        compress(spark.createDataFrame([(1, [1e30] * 8, "a")], kind))[0].collect()


def test_query_on_the_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = sorted(spark.read.parquet(f"{folder}/embeddings.parquet").collect())
    x = np.floor(4096 * np.array([r["embedding"] for r in rows])).astype(np.int64)
    code, error, books = plain(np.arange(len(x)), x)
    got = sorted(QUERIES["op13_vector_codes"](spark, folder).collect())
    assert [r["code"] for r in got] == ["".join(f"{c:02x}" for c in row) for row in code]
    assert [r["error"] for r in got] == error.tolist()
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()}
    by = {}
    for r, e in zip(rows, error.tolist(), strict=True):
        by[r["label"]] = by.get(r["label"], 0) + e
    assert [r["label_error"] for r in got] == [by[r["label"]] for r in rows]
