"""The booster against a plain one that tries every split on dense columns."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from wattshelf.operators.boosting import BoostSettings, SoftmaxTrees, contenders, fit_softmax_trees, send_nodes


def plain_booster(x, y, classes, rounds, depth, step=0.3, l2=1.0, least=1.0):
    margins = np.zeros((len(y), classes))
    for _ in range(rounds):
        p = np.exp(margins - margins.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        added = np.zeros_like(margins)
        for k in range(classes):
            g, h = p[:, k] - (y == k), 2 * p[:, k] * (1 - p[:, k])

            def grow(rows, level):
                score = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)  # noqa: B023, E731
                best = None
                if level < depth:
                    for f in range(x.shape[1]):
                        for cut in np.unique(x[rows, f])[1:]:
                            right = rows & (x[:, f] >= cut)
                            left = rows & ~right
                            if min(h[left].sum(), h[right].sum()) < least:
                                continue
                            gain = score(left) + score(right) - score(rows)
                            if gain > 1e-6 and (best is None or gain > best[0] * (1 + 1e-9)):
                                best = (gain, left, right)
                if best is None:
                    added[rows, k] = -step * g[rows].sum() / (h[rows].sum() + l2)
                else:
                    grow(best[1], level + 1)
                    grow(best[2], level + 1)

            grow(np.ones(len(y), bool), 0)
        margins = margins + added
    return margins


@pytest.fixture(scope="module")
def toy():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 7, (90, 6)) * (rng.random((90, 6)) < 0.6) / 4.0
    y = ((x[:, 0] > 0.5).astype(int) + (x[:, 1] + x[:, 2] > 1.0)) % 3
    return x, y


def frame(spark, x, y, parts):
    rows = [(Vectors.sparse(x.shape[1], {int(j): float(r[j]) for j in np.flatnonzero(r)}), float(label)) for r, label in zip(x, y)]
    return spark.createDataFrame(rows, ["features", "label_index"]).repartition(parts)


@pytest.mark.parametrize("sizes", [{}, {"rows_per_block": 17, "cells_per_part": 60, "fold_rounds": 1}])
def test_margins_equal_the_plain_booster(spark, toy, sizes):
    x, y = toy
    model = fit_softmax_trees(frame(spark, x, y, 3), BoostSettings(rounds=4, depth=3, **sizes))
    rows, features = np.nonzero(x)
    got = model.margins(rows, features, x[rows, features], len(y))
    assert np.allclose(got, plain_booster(x, y, 3, 4, 3), atol=1e-9)


def test_predictions_and_storage(spark, toy):
    x, y = toy
    data = frame(spark, x, y, 2)
    model = fit_softmax_trees(data, BoostSettings(rounds=30, depth=4))
    scored = model.transform(data).collect()
    assert np.mean([r["prediction"] == r["label_index"] for r in scored]) > 0.95
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in scored)
    again = SoftmaxTrees.from_rows(model.rows(spark))
    assert all(np.array_equal(getattr(again, n), getattr(model, n)) for n in ("feature", "cut", "value"))


def test_awkward_rows(spark):
    empty = Vectors.sparse(3, {})
    data = spark.createDataFrame([(empty, 0.0), (empty, 1.0), (Vectors.dense([0.0, 2.0, 0.0]), 1.0)] * 3, ["features", "label_index"])
    shares = [r["probability"] for r in fit_softmax_trees(data, BoostSettings(rounds=5, depth=2)).transform(data).collect()]
    assert shares[2][1] > shares[0][1] > 0
    with pytest.raises(ValueError, match="no rows"):
        fit_softmax_trees(data.limit(0))
    with pytest.raises(ValueError, match="negative"):
        fit_softmax_trees(spark.createDataFrame([(Vectors.dense([-1.0]), 0.0)], ["features", "label_index"]))


def test_a_level_sends_a_byte_per_row_and_class():
    """The sums stay in the parts of features: what a level shuffles does not depend on features or bins."""
    n, classes = 1000, 4
    empty = np.empty(0, np.int32)
    block = (np.zeros(n, np.int32), empty, empty, empty, empty, np.zeros(1, np.int64))
    current = np.full((classes, 3), -1, np.int32), np.zeros((classes, 3), np.int32), np.ones((classes, 2), bool)
    current[0][:, 0] = 7
    sent = send_nodes((5, block, None), current, 1, 3)
    assert [i for i, _ in sent] == [0, 1, 2] and all(message[:2] == ("nodes", 5) for _, message in sent)
    assert all(message[2].nbytes == n * classes and not message[2].any() for _, message in sent)


def test_parts_of_features_give_the_trees_of_one_part(spark, toy):
    x, y = toy
    data = frame(spark, x, y, 5)
    one = fit_softmax_trees(data, BoostSettings(rounds=6, depth=4))
    many = fit_softmax_trees(data, BoostSettings(rounds=6, depth=4, rows_per_block=7, cells_per_part=20, least_cells=10, fold_rounds=2))
    assert np.array_equal(one.feature, many.feature) and np.array_equal(one.cut, many.cut)
    assert np.allclose(one.value, many.value, atol=1e-12)


def test_whole_trees_of_classes_equal_levels_of_parts(spark, toy):
    """A round is one job where a task can hold all cells; the trees are those that a job per level finds."""
    x, y = toy
    data = frame(spark, x, y, 3).cache()
    runs = []
    counted = spark.sparkContext.statusTracker
    for number, changes in enumerate(({}, {"whole_parts": 0})):
        spark.sparkContext.setJobGroup(f"boost-{number}", "")
        runs.append(fit_softmax_trees(data, BoostSettings(rounds=5, depth=4, rows_per_block=11, **changes)))
        runs.append(len(counted().getJobIdsForGroup(f"boost-{number}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    whole, jobs, parts, more_jobs = runs
    assert np.array_equal(whole.feature, parts.feature) and np.array_equal(whole.cut, parts.cut)
    assert np.allclose(whole.value, parts.value, atol=1e-12)
    assert jobs <= more_jobs - 5
    data.unpersist()


def test_left_out_features_never_hold_the_best_split():
    """The bound on a feature's gain against every cut of random sums."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, columns = 40, 12
        g, h = rng.normal(size=n), rng.random(n)
        settings = BoostSettings(min_child_weight=1.0)
        totals = np.array([[g.sum(), h.sum()]])
        gains, sums = np.zeros(columns), np.zeros((columns, 3))
        for c in range(columns):
            rows = rng.permutation(n)[: rng.integers(1, n)]
            sums[c] = g[rows].sum(), np.abs(g[rows]).sum(), h[rows].sum()
            for cut in range(len(rows)):
                right_g, right_h = g[rows[cut:]].sum(), h[rows[cut:]].sum()
                left_g, left_h = totals[0] - (right_g, right_h)
                if min(left_h, right_h) >= 1.0:
                    gain = right_g**2 / (right_h + 1) + left_g**2 / (left_h + 1) - totals[0, 0] ** 2 / (totals[0, 1] + 1)
                    gains[c] = max(gains[c], gain)
        kept = contenders(np.zeros(columns, int), *sums.T, totals, settings)
        assert kept[gains.argmax()] or gains.max() <= 1e-6
