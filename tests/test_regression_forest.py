"""The regression forest against a plain tree that tries every cut, and its two phases against one another."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors

from wattshelf.operators import regression_forest as rf
from wattshelf.operators.regression_forest import RegressionSettings, fit_regression_forest
from wattshelf.plans import forecast


def plain_tree(x, y, w, depth, least):
    """Predictions of one tree on weighted rows."""
    out = np.full(len(y), (y * w).sum() / w.sum())
    best = None
    for f in range(x.shape[1]) if depth else ():
        for cut in np.unique(x[:, f])[1:]:
            right = x[:, f] >= cut
            counts = w[~right].sum(), w[right].sum()
            if min(counts) >= least:
                gain = sum((y[s] * w[s]).sum() ** 2 / n for s, n in zip((~right, right), counts))
                if best is None or gain > best[0] * (1 + 1e-12):
                    best = gain, right
    if best is not None and best[0] > (y * w).sum() ** 2 / w.sum() * (1 + 1e-9):
        for side in (best[1], ~best[1]):
            out[side] = plain_tree(x[side], y[side], w[side], depth - 1, least)
    return out


@pytest.fixture(scope="module")
def toy():
    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, 6, 300), rng.integers(0, 5, 300), rng.integers(0, 2, 300)], 1) - 2.0
    return x, 3.0 * x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.1, 300) + 1000.0


def frame(spark, x, y, parts):
    return spark.createDataFrame([(i, Vectors.dense(r.tolist()), float(v)) for i, (r, v) in enumerate(zip(x, y))], ["id", "features", "y"]).repartition(parts)


def predictions(model, data):
    return np.array([r["prediction"] for r in model.transform(data).orderBy("id").collect()])


def test_one_tree_equals_a_plain_one(toy):
    x, y = toy
    w = np.random.default_rng(1).poisson(1.0, len(y)).astype(np.uint8)
    used = w > 0
    bins = (x + 2).astype(np.uint8)
    settings = RegressionSettings(trees=1)
    tree = rf.grow(bins[used], y[used] - 1000, w[used], 5, np.random.default_rng(0), settings, 6, step=3)
    got = tree[3][rf.reached(bins[used], tree)]
    assert np.allclose(got, plain_tree(x[used], y[used] - 1000, w[used].astype(float), 5, 2))


def test_large_nodes_split_by_all_tasks_give_the_same_tree(spark, toy, monkeypatch):
    """A single tree draws all features: whether nodes are split from histograms or by one task makes no difference."""
    data = frame(spark, *toy, 3).cache()
    found = [
        predictions(fit_regression_forest(data, RegressionSettings(trees=1, depth=6, local_rows=n), label="y"), data) for n in (10_000, 40, 1)
    ]
    assert np.allclose(found[0], found[1]) and np.allclose(found[0], found[2])
    data.unpersist()


def test_passes_of_few_trees_give_the_same_forest(spark, toy):
    data = frame(spark, *toy, 4).cache()
    one, many = (
        fit_regression_forest(data, RegressionSettings(trees=7, depth=6, local_rows=90, pass_bytes=size, part_bytes=size), label="y") for size in (10**9, 5000)
    )
    assert all(np.allclose(a, b) for a, b in zip(one.arrays, many.arrays)) and one.trees == 7
    assert np.abs(predictions(one, data) - toy[1]).mean() < 0.6 * np.abs(toy[1] - toy[1].mean()).mean()
    data.unpersist()


def test_model_survives_storage_and_rows_of_several_features(spark, toy, tmp_path):
    data = frame(spark, *toy, 2)
    model = fit_regression_forest(data, RegressionSettings(trees=3, depth=4), label="y")
    PipelineModel([model]).write().overwrite().save(str(tmp_path / "forest"))
    loaded = PipelineModel.load(str(tmp_path / "forest"))
    assert np.array_equal(predictions(loaded, data), predictions(model, data))


def test_awkward_rows(spark):
    same = frame(spark, np.ones((5, 2)), np.full(5, 4.0), 2)
    assert np.allclose(predictions(fit_regression_forest(same, RegressionSettings(trees=40), label="y"), same), 4.0)
    with pytest.raises(ValueError, match="no rows"):
        fit_regression_forest(same.limit(0), label="y")
    for x, y in ((np.nan, 1.0), (np.inf, 1.0), (1.0, np.nan)):
        with pytest.raises(ValueError, match="finite"):
            fit_regression_forest(frame(spark, np.array([[x], [0.0]]), np.array([y, 1.0]), 1), label="y")


def test_a_row_is_a_byte_per_feature(spark, toy):
    """A task holds bins and targets, not dense statistics of open nodes; the roster uses this forest."""
    assert isinstance(forecast.default_regressor(), rf.RegressionForest)
    bins, targets = np.zeros((50, 7), np.uint8), np.zeros(50)
    arrays = [np.array([v], kind) for v, kind in zip((-1, 0, -1, 0.0), rf.NODE_KINDS)]
    settings = RegressionSettings(trees=1)
    sent = list(rf.deal_rows([(0, (bins, targets))], {0: (arrays, np.array([0]))}, settings))
    taken = int((rf.bootstrap(0, 0, 50, settings) > 0).sum())
    assert len(sent) == 1 and sum(a.nbytes for a in sent[0][1][1:]) == taken * (7 + 8 + 1)


def test_edges_keep_rare_values_and_weigh_alike():
    assert rf.stride_edges(np.array([0.0] * 500 + [1.0]), 32).tolist() == [1.0]
    edges = rf.stride_edges(np.random.default_rng(0).normal(size=4096), 32)
    assert len(edges) == 31 and np.all(np.diff(edges) > 0)
