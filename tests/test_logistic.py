"""The logistic solver against its definition, and the number of passes it takes."""

import numpy as np
from pyspark.ml.linalg import Vectors

from wattshelf.operators import logistic


def rare_terms(n=200, width=400):
    rng = np.random.default_rng(5)
    x = np.zeros((n, width))
    y = rng.integers(0, 3, n)
    for i in range(n):
        x[i, [y[i] if rng.random() < 0.6 else 3, *rng.choice(np.arange(4, width), 6, replace=False)]] = 1.0
    return x / np.linalg.norm(x, axis=1, keepdims=True), y, np.where(y == 0, 2.0, 0.5)


def frame(spark, x, y, w):
    rows = [(Vectors.sparse(x.shape[1], {int(j): float(r[j]) for j in np.flatnonzero(r)}), float(k), float(v)) for r, k, v in zip(x, y, w)]
    return spark.createDataFrame(rows, ["features", "label_index", "weight"]).repartition(3)


def slope(model, x, y, w, penalty):
    beta = model.coefficientMatrix.toArray()
    z = x @ beta.T + model.interceptVector.toArray()
    p = np.exp(z - z.max(1, keepdims=True))
    rest = (p / p.sum(1, keepdims=True) - np.eye(3)[y]) * w[:, None] / w.sum()
    return np.concatenate([(rest.T @ x + penalty * beta).ravel(), rest.sum(0)])


def test_few_passes_reach_the_minimum(spark, monkeypatch):
    """On rare terms, in blocks and three partitions, 60 passes leave no gradient."""
    x, y, w = rare_terms()
    seen = []
    plain = logistic.minimise
    monkeypatch.setattr(logistic, "minimise", lambda f, *rest: plain(lambda p: (seen.append(1), f(p))[1], *rest))
    model = logistic.SoftmaxRegression(60, 1 / 200, rows_per_block=32).fit(frame(spark, x, y, w))
    assert np.abs(slope(model, x, y, w, 1 / 200)).max() <= 1e-6 and len(seen) <= 60
    assert abs(model.interceptVector.toArray().sum()) < 1e-9
