"""Grouped training: gradients, one distributed step against NumPy by hand, averaging."""

import numpy as np
from pyspark.sql import functions as F

from vitalgrid.operators import grouped as GR


def test_parameter_count_matches_reference_shape():
    assert GR.n_params(14) == 1025          # 14-32-16-1


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(20, 3)), (rng.random(20) < 0.4).astype(float)
    th = GR.init_params(3, 1)
    _, g = GR.loss_and_grad_sums(x, y, th, 3)
    eps = 1e-6
    for i in rng.choice(len(th), 25, replace=False):
        d = np.zeros_like(th)
        d[i] = eps
        num = (GR.loss_and_grad_sums(x, y, th + d, 3)[0] - GR.loss_and_grad_sums(x, y, th - d, 3)[0]) / (2 * eps)
        assert abs(num - g[i]) < 1e-5 * max(1.0, abs(num))


def test_distributed_step_equals_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(f"g{i % 2}", rng.normal(size=3).tolist(), float(rng.random() < 0.5)) for i in range(200)]
    df = spark.createDataFrame(rows, "group string, x array<double>, y double").repartition(5)
    params = {"g0": GR.init_params(3, 1), "g1": GR.init_params(3, 2)}
    got = GR.gradient_step(df, "group", "x", "y", params, 3)
    for g in ("g0", "g1"):
        xs = np.array([r[1] for r in rows if r[0] == g])
        ys = np.array([r[2] for r in rows if r[0] == g])
        loss, grad = GR.loss_and_grad_sums(xs, ys, params[g], 3)
        n, l2, g2 = got[g]
        assert n == len(xs) and abs(l2 - loss) < 1e-9 and np.allclose(g2, grad, atol=1e-10)


def test_average_parameters_spark_equals_numpy(spark):
    vecs = [[1.0, 2.0], [3.0, 6.0], [5.0, 0.0]]
    counts = [1, 1, 2]
    df = spark.createDataFrame(list(zip(vecs, counts)), "w array<double>, n long")
    got = GR.average_parameters(df, "w", "n").first()["w"]
    assert np.allclose(got, GR.weighted_average([np.array(v) for v in vecs], counts))
    same = spark.createDataFrame([([2.0, 2.0], 3), ([2.0, 2.0], 9)], "w array<double>, n long")
    assert GR.average_parameters(same, "w", "n").first()["w"] == [2.0, 2.0]
    assert F is not None
