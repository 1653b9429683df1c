"""A random forest for numbers: large nodes are split from histograms of all tasks, small ones are finished where their rows are.

Spark ML's forest sums dense histograms of every open node in every task, a few nodes to a pass where trees are deep. Here a row is a
byte per feature. As long as a node holds more than ``local_rows`` rows, all trees grow by a pass over the blocks a level; then the rows
of each remaining node go to one task, a number of trees at a time, which grows the rest of that tree. What reaches the driver is one
split per large node and the finished nodes: the model itself, at most 2 ** (depth + 1) nodes a tree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattshelf.functions.columns import quoted
from wattshelf.session import delete_scratch, scratch_path

#: Arrays of a tree: feature (-1 for a leaf), bin from which rows go right, left child (the right one follows), mean.
NODE_KINDS = (np.int16, np.uint8, np.int32, np.float64)
NODE_NAMES = ("feature", "least", "left", "value")
BLOCK_SCHEMA = "n int, bins binary, targets binary"


@dataclass(frozen=True)
class RegressionSettings:
    """``local_rows``, ``pass_bytes`` (shuffled at a time) and ``part_bytes`` size the tasks; the others are the model's.

    Every node draws a third of the features (all for a single tree), every tree a Poisson(1) bootstrap; ``least_rows`` counts its repeats.
    """

    trees: int = 200
    depth: int = 15
    least_rows: int = 2
    seed: int = 42
    max_bins: int = 32
    local_rows: int = 262_144
    pass_bytes: int = 4_000_000_000
    part_bytes: int = 64_000_000

    def drawn(self, width: int) -> int:
        return width if self.trees == 1 else max(1, math.ceil(width / 3))


def stride_edges(values: np.ndarray, max_bins: int) -> np.ndarray:
    """Edges of at most ``max_bins`` bins: every different value but the lowest where they are few, else such that bins weigh alike."""
    distinct, counts = np.unique(values, return_counts=True)
    if len(distinct) <= max_bins:
        return distinct[1:]
    before = np.cumsum(counts)[:-1]  # weight below each edge
    wanted = np.arange(1, max_bins) * len(values) / max_bins
    return distinct[1:][np.unique(np.minimum(np.searchsorted(before, wanted), len(before) - 1))]


def feature_edges(numbers: DataFrame, width: int, settings: RegressionSettings, shares: int = 4096) -> list[np.ndarray]:
    """Edges per feature from approximate quantiles of all rows; features x ``shares`` numbers reach the driver."""
    wanted = [i / shares for i in range(shares + 1)]
    cells = numbers.select(F.posexplode("x").alias("feature", "value"))
    rows = cells.groupBy("feature").agg(F.percentile_approx("value", wanted, 4 * shares).alias("q")).collect()
    found = {row["feature"]: stride_edges(np.array(row["q"]), settings.max_bins) for row in rows}
    return [found[f] for f in range(width)]


def bins_of_rows(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins (rows x features): the number of edges at or below a value."""
    return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], 1).astype(np.uint8)


def binned_blocks(numbers: DataFrame, edges: list[np.ndarray], mean: float, path: str) -> RDD:
    """(number, (bins, targets less ``mean``)) of the blocks, written once below ``path`` and dealt evenly over all cores."""
    spark, width = numbers.sparkSession, len(edges)

    def packed(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
                columns = bins_of_rows(x, edges).tobytes(), (batch.column(1).to_numpy(zero_copy_only=False) - mean).tobytes()
                arrays = [pa.array([batch.num_rows], pa.int32()), *[pa.array([a], pa.binary()) for a in columns]]
                yield pa.RecordBatch.from_arrays(arrays, ["n", "bins", "targets"])

    numbers.mapInArrow(packed, BLOCK_SCHEMA).write.parquet(path)
    stored = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    count, cores = stored.count(), spark.sparkContext.defaultParallelism
    numbered = stored.rdd.zipWithIndex().map(lambda pair: (pair[1], pair[0]))
    return numbered.partitionBy(max(1, min(count, max(cores, -(-count // 16))))).mapValues(
        lambda row: (np.frombuffer(row["bins"], np.uint8).reshape(row["n"], width), np.frombuffer(row["targets"], np.float64))
    )


def bootstrap(at: int, tree: int, n: int, settings: RegressionSettings) -> np.ndarray:
    """How often a tree takes each row of a block."""
    return np.random.default_rng((settings.seed, 0, tree, at)).poisson(1.0, n).astype(np.uint8)


def draw(rng: np.random.Generator, nodes: int, width: int, take: int) -> np.ndarray:
    """The features that each node may split on (nodes x take)."""
    if take == width:
        return np.tile(np.arange(width), (nodes, 1))
    return np.argpartition(rng.random((nodes, width)), take - 1, axis=1)[:, :take]


def histograms(bins: np.ndarray, weights: np.ndarray, sums: np.ndarray, node: np.ndarray, chosen: np.ndarray, size: int) -> np.ndarray:
    """Rows and sums of targets (2 x nodes x drawn features x bins)."""
    nodes, take = chosen.shape
    flat, base, place = bins.ravel(), np.arange(len(node)) * bins.shape[1], node.astype(np.int64) * size
    out = np.empty((2, nodes, take, size))
    for j in range(take):
        key = place + flat[base + chosen[node, j]]
        out[0, :, j] = np.bincount(key, weights, nodes * size).reshape(nodes, size)
        out[1, :, j] = np.bincount(key, sums, nodes * size).reshape(nodes, size)
    return out


def best_splits(held: np.ndarray, chosen: np.ndarray, least_rows: int) -> tuple[np.ndarray, ...]:
    """(feature, bin, rows left, sum left, rows right, sum right) per node, the split that lowers the variance most; feature -1 for none."""
    upto = np.flip(np.cumsum(np.flip(held, 3), 3), 3)
    whole = upto[:, :, :, :1]
    (right, right_sum), (left, left_sum) = upto[:, :, :, 1:], whole - upto[:, :, :, 1:]
    valid = (right >= least_rows) & (left >= least_rows)
    gain = right_sum**2 / np.maximum(right, 1) + left_sum**2 / np.maximum(left, 1)
    nodes, _, cuts = gain.shape
    if not cuts:
        return np.full(nodes, -1), *(np.zeros(nodes),) * 5
    gain = np.where(valid, gain, -1.0).reshape(nodes, -1)
    top = gain.argmax(1)
    at = np.arange(nodes), top // cuts, top % cuts
    plain = whole[1, :, 0, 0] ** 2 / np.maximum(whole[0, :, 0, 0], 1)
    better = gain[at[0], top] > plain * (1 + 1e-12) + 1e-300
    feature = np.where(better, chosen[at[0], at[1]], -1)
    return feature, at[2] + 1, left[at], left_sum[at], right[at], right_sum[at]


def joined_nodes(levels: list[tuple]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate([level[i] for level in levels]).astype(kind) for i, kind in enumerate(NODE_KINDS))


def grow(bins: np.ndarray, targets: np.ndarray, weights: np.ndarray, levels: int, rng: np.random.Generator, settings: RegressionSettings, size: int, step: int = 1024) -> tuple:
    """The arrays of the tree below one node, from all of its rows; ``step`` nodes are looked at together."""
    take, weights = settings.drawn(bins.shape[1]), weights.astype(np.float64)
    sums = targets * weights
    out = [[np.array([-1]), np.zeros(1), np.array([-1]), np.array([sums.sum() / max(weights.sum(), 1)])]]
    starts, made, places = np.array([0, len(targets)]), 1, np.array([0])  # rows of a node stand together
    for _ in range(levels):
        nodes = len(starts) - 1
        if not nodes:
            break
        node = np.repeat(np.arange(nodes), np.diff(starts))
        found = []
        for low in range(0, nodes, step):
            high = min(nodes, low + step)
            rows = slice(starts[low], starts[high])
            chosen = draw(rng, high - low, bins.shape[1], take)
            held = histograms(bins[rows], weights[rows], sums[rows], node[rows] - low, chosen, size)
            found.append(best_splits(held, chosen, settings.least_rows))
        feature, least, left, left_sum, right, right_sum = (np.concatenate([f[i] for f in found]) for i in range(6))
        split = np.flatnonzero(feature >= 0)
        if not len(split):
            break
        last = out[-1]
        at = places[split]
        last[0][at], last[1][at], last[2][at] = feature[split], least[split], made + 2 * np.arange(len(split))
        rows_below = np.stack([left[split], right[split]], 1).ravel()
        sums_below = np.stack([left_sum[split], right_sum[split]], 1).ravel()
        children = len(rows_below)
        out.append([np.full(children, -1), np.zeros(children), np.full(children, -1), sums_below / rows_below])
        made += children
        places = np.flatnonzero(rows_below >= 2 * settings.least_rows)  # the others stay leaves
        number = np.full(children, -1)
        number[places] = np.arange(len(places))
        first = np.full(nodes, -1)
        first[split] = 2 * np.arange(len(split))
        kept = np.flatnonzero(first[node] >= 0)
        to = first[node[kept]] + (bins[kept, feature[node[kept]]] >= least[node[kept]])
        open_ = number[to] >= 0
        kept, to = kept[open_], number[to[open_]]
        order = np.argsort(to.astype(np.uint16) if len(places) <= 1 << 16 else to, kind="stable")
        kept = kept[order]
        bins, weights, sums = bins[kept], weights[kept], sums[kept]
        starts = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=len(places)))])
    return joined_nodes(out)


def reached(bins: np.ndarray, tree: tuple) -> np.ndarray:
    """The leaf of one tree that each row reaches."""
    feature, least, left, _ = tree
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(rows):
        at = node[rows]
        f = feature[at]
        inner = f >= 0
        rows, at, f = rows[inner], at[inner], f[inner]
        node[rows] = left[at] + (bins[rows, f] >= least[at])
    return node


@dataclass
class _Top:
    """The upper part of a tree while it grows: its arrays, depth and rows per node, and which nodes found no split."""

    arrays: list[np.ndarray]
    depth: np.ndarray
    rows: np.ndarray
    closed: np.ndarray


def count_level(items, tops: dict[int, tuple], level: int, width: int, size: int, settings: RegressionSettings):
    """(tree, histograms) of a task's blocks for the open nodes (tree: its arrays and its open nodes) of a level."""
    blocks = list(items)
    for tree, (arrays, open_nodes) in tops.items():
        chosen = level_draw(tree, level, len(open_nodes), width, settings)
        number = np.full(len(arrays[0]), -1)
        number[open_nodes] = np.arange(len(open_nodes))
        total = np.zeros((2, *chosen.shape, size))
        for at, (bins, targets) in blocks:
            weights = bootstrap(at, tree, len(targets), settings)
            taken = np.flatnonzero(weights)
            node = number[reached(bins[taken], arrays)]
            taken, node = taken[node >= 0], node[node >= 0]
            times = weights[taken].astype(np.float64)
            total += histograms(bins[taken], times, targets[taken] * times, node, chosen, size)
        yield tree, total


def level_draw(tree: int, level: int, nodes: int, width: int, settings: RegressionSettings) -> np.ndarray:
    return draw(np.random.default_rng((settings.seed, 1, tree, level)), nodes, width, settings.drawn(width))


def deal_rows(items, tops: dict[int, tuple], settings: RegressionSettings):
    """((tree, node), (bins, targets, weights)) of a task's blocks for the unfinished nodes (tree: its arrays and those nodes)."""
    for at, (bins, targets) in items:
        for tree, (arrays, unfinished) in tops.items():
            weights = bootstrap(at, tree, len(targets), settings)
            taken = np.flatnonzero(weights)
            node = reached(bins[taken], arrays)
            order = np.argsort(node, kind="stable")
            taken, node = taken[order], node[order]
            for m in unfinished.tolist():
                rows = taken[np.searchsorted(node, m) : np.searchsorted(node, m, side="right")]
                if len(rows):
                    yield (tree, m), (at, bins[rows], targets[rows], weights[rows])


def grow_dealt(items, depth_of: dict[tuple, int], settings: RegressionSettings, size: int):
    """((tree, node), arrays) of the nodes whose rows came to this task."""
    held: dict[tuple, list] = {}
    for key, part in items:
        held.setdefault(key, []).append(part)
    for key in sorted(held):
        parts = sorted(held.pop(key), key=lambda part: part[0])
        bins, targets, weights = (np.concatenate([part[i] for part in parts]) for i in (1, 2, 3))
        rng = np.random.default_rng((settings.seed, 2, *key))
        yield key, grow(bins, targets, weights, settings.depth - depth_of[key], rng, settings, size)


def fit_regression_forest(train: DataFrame, settings: RegressionSettings | None = None, features: str = "features", label: str = "label") -> RegressionForestModel:
    """A forest of variance trees. No rows, a missing or non-finite feature or target are errors."""
    settings = settings or RegressionSettings()
    spark = train.sparkSession
    context = spark.sparkContext
    numbers = train.select(vector_to_array(quoted(features)).alias("x"), quoted(label).cast("double").alias("y"))
    unsound = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    bad = F.col("x").isNull() | unsound(F.col("y")) | F.exists("x", unsound)
    row = numbers.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), F.avg("y").alias("mean"), F.max(F.size("x")).alias("width"), F.min(F.size("x")).alias("least")
    ).first()
    if not row["n"]:
        raise ValueError("no rows to train on")
    if row["bad"] or row["width"] != row["least"] or not row["width"]:
        raise ValueError("features and targets must be finite numbers, and as many features in every row")
    n, mean, width = row["n"], row["mean"], row["width"]
    edges = feature_edges(numbers, width, settings)
    size = 1 + max(len(e) for e in edges)
    path = scratch_path(spark, "forest-blocks")
    blocks = binned_blocks(numbers, edges, mean, path).persist(StorageLevel.MEMORY_AND_DISK)
    tops = [
        _Top([np.array([v], kind) for v, kind in zip((-1, 0, -1, 0.0), NODE_KINDS)], np.zeros(1, int), np.array([float(n)]), np.zeros(1, bool))
        for _ in range(settings.trees)
    ]
    parts = max(1, context.defaultParallelism)
    try:
        for level in range(settings.depth):
            open_of = {
                tree: np.flatnonzero((top.depth == level) & (top.rows > settings.local_rows)) for tree, top in enumerate(tops)
            }
            asked = context.broadcast({tree: (tops[tree].arrays, nodes) for tree, nodes in open_of.items() if len(nodes)})
            if not asked.value:
                break
            found = (
                blocks.mapPartitions(lambda items: count_level(items, asked.value, level, width, size, settings))  # noqa: B023
                .reduceByKey(np.add, parts)
                .map(lambda pair: (pair[0], best_splits(pair[1], level_draw(pair[0], level, pair[1].shape[1], width, settings), settings.least_rows), pair[1][:, :, 0].sum(2)))  # noqa: B023
                .collect()
            )
            for tree, splits, (rows, sums) in found:
                _extend(tops[tree], open_of[tree], splits, rows, sums)
            asked.destroy()
        per_tree = n * 0.64 * (width + 9)
        step = int(max(1, min(settings.trees, settings.pass_bytes // max(per_tree, 1))))
        model = []
        for low in range(0, settings.trees, step):
            trees = range(low, min(settings.trees, low + step))
            unfinished = {tree: np.flatnonzero((tops[tree].arrays[0] < 0) & ~tops[tree].closed) for tree in trees}
            keys = sorted(((tree, int(m)) for tree in trees for m in unfinished[tree]), key=lambda key: -tops[key[0]].rows[key[1]])
            tasks = min(max(1, len(keys)), max(4 * parts, math.ceil(per_tree * len(trees) / settings.part_bytes)))
            part_of = {key: i % tasks for i, key in enumerate(keys)}  # the largest are dealt first
            asked = context.broadcast({tree: (tops[tree].arrays, unfinished[tree]) for tree in trees})
            depth_of = context.broadcast({key: int(tops[key[0]].depth[key[1]]) for key in keys})
            grown = dict(
                blocks.mapPartitions(lambda items: deal_rows(items, asked.value, settings))  # noqa: B023
                .partitionBy(tasks, lambda key: part_of[key])  # noqa: B023
                .mapPartitions(lambda items: grow_dealt(items, depth_of.value, settings, size))  # noqa: B023
                .collect()
            )
            model += [_joined(tops[tree].arrays, unfinished[tree], {m: grown.get((tree, m)) for m in unfinished[tree].tolist()}) for tree in trees]
            asked.destroy()
            depth_of.destroy()
    finally:
        blocks.unpersist()
        delete_scratch(spark, path)
    starts = np.cumsum([0, *[len(tree[0]) for tree in model]])
    arrays = [np.concatenate([tree[i] for tree in model]) for i in range(4)]
    arrays[3] += mean
    return RegressionForestModel(features, starts, arrays, edges)


def _extend(top: _Top, nodes: np.ndarray, splits: tuple, rows: np.ndarray, sums: np.ndarray) -> None:
    feature, least, left, left_sum, right, right_sum = splits
    top.arrays[3][nodes] = sums / np.maximum(rows, 1)
    top.closed[nodes] = True
    split = np.flatnonzero(feature >= 0)
    at, made = nodes[split], len(top.depth)
    top.arrays[0][at], top.arrays[1][at], top.arrays[2][at] = feature[split], least[split], made + 2 * np.arange(len(split))
    below, sums_below = (np.stack([a[split], b[split]], 1).ravel() for a, b in ((left, right), (left_sum, right_sum)))
    fresh = [np.full(len(below), -1), np.zeros(len(below)), np.full(len(below), -1), sums_below / np.maximum(below, 1)]
    top.arrays = [np.concatenate([a, b.astype(a.dtype)]) for a, b in zip(top.arrays, fresh)]
    top.depth = np.concatenate([top.depth, np.repeat(top.depth[at] + 1, 2)])
    top.rows = np.concatenate([top.rows, below])
    top.closed = np.concatenate([top.closed, np.zeros(len(below), bool)])


def _joined(arrays: list[np.ndarray], unfinished: np.ndarray, grown: dict[int, tuple | None]) -> list[np.ndarray]:
    """A tree's upper part with what was grown below its unfinished nodes (None where no row was drawn)."""
    pieces, made = [[a.copy() for a in arrays]], len(arrays[0])
    for m in unfinished.tolist():
        below = grown[m]
        if below is None:
            continue
        left = np.where(below[2] >= 0, below[2] + (made - 1), -1).astype(NODE_KINDS[2])  # the first node takes the place of m
        for i, a in enumerate((below[0], below[1], left, below[3])):
            pieces[0][i][m] = a[0]
        pieces.append([a[1:] for a in (below[0], below[1], left, below[3])])
        made += len(below[0]) - 1
    return [np.concatenate([piece[i] for piece in pieces]) for i in range(4)]


def forest_means(bins: np.ndarray, starts: np.ndarray, arrays: list[np.ndarray]) -> np.ndarray:
    """Means of the trees' leaves per row."""
    total = np.zeros(len(bins))
    for low, high in zip(starts[:-1], starts[1:]):
        tree = tuple(a[low:high] for a in arrays)
        total += tree[3][reached(bins, tree)]
    return total / (len(starts) - 1)


class _ForestWriter(MLWriter):
    def __init__(self, model: RegressionForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        model, spark = self.model, self.sparkSession
        DefaultParamsWriter.saveMetadata(model, path, spark)
        trees = [
            (t, *(a[low:high].tobytes() for a in model.arrays)) for t, (low, high) in enumerate(zip(model.starts[:-1].tolist(), model.starts[1:].tolist()))
        ]
        columns = ", ".join(f"{name} binary" for name in NODE_NAMES)
        spark.createDataFrame(trees, f"tree int, {columns}").write.parquet(f"{path}/trees")
        edges = [(f, e.tolist()) for f, e in enumerate(model.edges)]
        spark.createDataFrame(edges, "feature int, edges array<double>").write.parquet(f"{path}/edges")


class _ForestReader(MLReader):
    def load(self, path: str) -> RegressionForestModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        trees = sorted(spark.read.parquet(f"{path}/trees").collect(), key=lambda row: row["tree"])
        edges = sorted(spark.read.parquet(f"{path}/edges").collect(), key=lambda row: row["feature"])
        parts = [[np.frombuffer(row[name], kind) for row in trees] for name, kind in zip(NODE_NAMES, NODE_KINDS)]
        starts = np.cumsum([0, *[len(a) for a in parts[0]]])
        model = RegressionForestModel("features", starts, [np.concatenate(p) for p in parts], [np.array(row["edges"]) for row in edges])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class RegressionForestModel(Model, HasFeaturesCol, HasPredictionCol, MLWritable, MLReadable):
    """Fitted trees, one after the other in four arrays (``NODE_NAMES``), and the edges of the bins. Adds ``prediction``."""

    def __init__(self, features: str, starts: np.ndarray, arrays: list[np.ndarray], edges: list[np.ndarray]):
        super().__init__()
        self.starts, self.arrays, self.edges = starts, arrays, edges
        self._shared = None
        self._set(featuresCol=features, predictionCol="prediction")

    @property
    def trees(self) -> int:
        return len(self.starts) - 1

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self._shared is None:
            self._shared = dataset.sparkSession.sparkContext.broadcast((self.starts, self.arrays, self.edges))
        shared = self._shared

        @F.pandas_udf("double")
        def means(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series(np.zeros(0))
            starts, arrays, edges = shared.value
            return pd.Series(forest_means(bins_of_rows(np.stack(x.to_list()), edges), starts, arrays))

        return dataset.withColumn(self.getPredictionCol(), means(vector_to_array(quoted(self.getFeaturesCol()))))

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


@dataclass(frozen=True)
class RegressionForest:
    """The library's forest, with ``fit`` and getters like Spark's estimator."""

    settings: RegressionSettings
    features: str = "features"
    label: str = "label"

    def fit(self, train: DataFrame) -> RegressionForestModel:
        return fit_regression_forest(train, self.settings, self.features, self.label)

    def getNumTrees(self) -> int:  # noqa: N802
        return self.settings.trees

    def getMaxDepth(self) -> int:  # noqa: N802
        return self.settings.depth

    def getMinInstancesPerNode(self) -> int:  # noqa: N802
        return self.settings.least_rows

    def getSeed(self) -> int:  # noqa: N802
        return self.settings.seed
