"""Multinomial logistic regression by L-BFGS on the features as they are; the loss is summed by the executors.

Spark ML's own solver divides every feature by its standard deviation and weighs the penalty by the inverse. Text vectors are of unit
length already, and the scaled problem, whose rare terms weigh a thousand times the frequent ones, takes many more passes to its minimum.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattshelf.functions.columns import quoted
from wattshelf.operators.boosting import sparse_cells
from wattshelf.session import materialise

BLOCK_SCHEMA = "labels binary, weights binary, sizes binary, features binary, values binary"
BLOCK_KINDS = (np.int32, np.float64, np.int32, np.int32, np.float64)


def pack_rows(batches, rows_per_block: int):
    """Arrow batches of (label, weight, indices, values) to one packed row per block, without zeros."""
    names = [part.split()[0] for part in BLOCK_SCHEMA.split(", ")]
    for batch in (b.slice(at, rows_per_block) for b in batches for at in range(0, b.num_rows, rows_per_block)):
        label, weight, indices, values = (batch.column(i) for i in range(4))
        lengths = np.diff(indices.offsets.to_numpy())
        taken = values.flatten().to_numpy(zero_copy_only=False)
        used = taken != 0
        sizes = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[used], minlength=len(lengths))
        columns = (
            label.to_numpy(zero_copy_only=False), weight.to_numpy(zero_copy_only=False), sizes,
            indices.flatten().to_numpy(zero_copy_only=False)[used], taken[used],
        )
        yield pa.RecordBatch.from_arrays([pa.array([a.astype(k).tobytes()], pa.binary()) for a, k in zip(columns, BLOCK_KINDS)], names)


def row_blocks(train: DataFrame, features: str, label: str, weight: str, rows_per_block: int) -> tuple[RDD, int]:
    """(numbered blocks of (labels, weights, sizes, features, values), their number): written once, dealt evenly over all cores."""
    indices, values = sparse_cells(features)
    flat = train.select(
        quoted(label).cast("int").alias("label"), quoted(weight).cast("double").alias("weight"), indices.alias("indices"), values.alias("values")
    )
    parts = max(1, -(-train.count() // rows_per_block))
    packed = materialise(flat.repartition(parts).mapInArrow(partial(pack_rows, rows_per_block=rows_per_block), BLOCK_SCHEMA), "row-blocks")
    count = packed.count()
    numbered = packed.rdd.zipWithIndex().map(lambda pair: (pair[1], pair[0]))
    dealt = numbered.partitionBy(max(1, min(count, max(train.sparkSession.sparkContext.defaultParallelism, -(-count // 32)))))
    return dealt.mapValues(lambda row: tuple(np.frombuffer(value, kind) for value, kind in zip(row, BLOCK_KINDS))), count


def loss_and_gradient(blocks, coefficients: np.ndarray, intercepts: np.ndarray):
    """(weighted log loss, gradient by coefficients, gradient by intercepts) summed over a task's blocks."""
    classes, width = coefficients.shape
    loss, by_coefficient, by_intercept = 0.0, np.zeros((classes, width)), np.zeros(classes)
    for _, (labels, weights, sizes, features, values) in blocks:
        n = len(labels)
        every, rows = np.arange(n), np.repeat(np.arange(n), sizes)
        margins = np.stack([np.bincount(rows, values * coefficients[k][features], n) for k in range(classes)]) + intercepts[:, None]
        margins -= margins.max(0)
        shares = np.exp(margins)
        total = shares.sum(0)
        loss += float(weights @ (np.log(total) - margins[labels, every]))
        rest = shares / total
        rest[labels, every] -= 1.0
        rest *= weights
        by_intercept += rest.sum(1)
        for k in range(classes):
            by_coefficient[k] += np.bincount(features, values * rest[k][rows], width)
    yield loss, by_coefficient, by_intercept


def minimise(evaluate, x: np.ndarray, iterations: int, tolerance: float, memory: int = 10) -> tuple[np.ndarray, int]:
    """L-BFGS with halving steps: (point, steps taken), until no part of the gradient is above ``tolerance``."""
    value, slope = evaluate(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for step in range(iterations):
        if np.abs(slope).max() <= tolerance:
            return x, step
        direction, factors = -slope, []
        for s, y, scale in reversed(pairs):
            factors.append(scale * (s @ direction))
            direction = direction - factors[-1] * y
        if pairs:
            s, y, scale = pairs[-1]
            direction = direction / (scale * (y @ y))
        for (s, y, scale), factor in zip(pairs, reversed(factors)):
            direction = direction + (factor - scale * (y @ direction)) * s
        downhill = float(slope @ direction)
        length = 1.0 if pairs else min(1.0, 1.0 / float(np.abs(slope).sum()))
        while True:
            to = x + length * direction
            next_value, next_slope = evaluate(to)
            if next_value <= value + 1e-4 * length * downhill or np.abs(next_slope).max() <= tolerance:
                break
            if length < 1e-8:  # the loss no longer tells the points apart
                return x, step
            length /= 2
        s, y = to - x, next_slope - slope
        if s @ y > 0:
            pairs = [*pairs[-(memory - 1) :], (s, y, 1.0 / float(s @ y))]
        x, value, slope = to, next_value, next_slope
    return x, iterations


@dataclass(frozen=True)
class SoftmaxRegression:
    """Minimises ``sum(w * log loss) / sum(w) + penalty / 2 * |coefficients|^2``; intercepts are not penalised.

    ``fit`` gives Spark's model. ``tolerance`` bounds the gradient; ``iterations`` passes are a bound, as in Spark.
    """

    iterations: int
    penalty: float
    features: str = "features"
    label: str = "label_index"
    weight: str = "weight"
    tolerance: float = 1e-7
    rows_per_block: int = 1024

    def fit(self, train: DataFrame) -> LogisticRegressionModel:
        context = train.sparkSession.sparkContext
        shape = F.unwrap_udt(quoted(self.features))
        sums = train.groupBy(quoted(self.label).cast("int").alias("k")).agg(
            F.sum(quoted(self.weight)).alias("w"), F.max(F.coalesce(shape["size"], F.size(shape["values"]))).alias("width")
        ).collect()
        if not sums:
            raise ValueError("no rows to train on")
        width, classes, total = max(r["width"] for r in sums), max(r["k"] for r in sums) + 1, sum(r["w"] for r in sums)
        blocks, _ = row_blocks(train, self.features, self.label, self.weight, self.rows_per_block)
        blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        depth = 1 if blocks.getNumPartitions() <= 32 else 2

        def evaluate(x: np.ndarray) -> tuple[float, np.ndarray]:
            shared = context.broadcast((x[:-classes].reshape(classes, width), x[-classes:]))
            found = blocks.mapPartitions(lambda held: loss_and_gradient(held, *shared.value))
            loss, *slopes = found.treeReduce(lambda a, b: tuple(m + n for m, n in zip(a, b)), depth)
            shared.destroy()
            slope = np.concatenate([part.ravel() for part in slopes]) / total
            slope[:-classes] += self.penalty * x[:-classes]
            return loss / total + self.penalty / 2 * float(x[:-classes] @ x[:-classes]), slope

        start = np.zeros(classes * width + classes)
        shares = {r["k"]: r["w"] for r in sums}
        known = np.array([shares.get(k, 0.0) for k in range(classes)])
        start[-classes:] = np.log1p(known) - np.log1p(known).mean()
        try:
            x, _ = minimise(evaluate, start, self.iterations, self.tolerance)
        finally:
            blocks.unpersist()
        coefficients, intercepts = x[:-classes].reshape(classes, width), x[-classes:] - x[-classes:].mean()
        made = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
            f"softmax_{id(self):x}",
            _py2java(context, DenseMatrix(classes, width, coefficients.ravel(order="F"))),
            _py2java(context, DenseVector(intercepts)),
            classes,
            True,
        )
        return LogisticRegressionModel(made).setFeaturesCol(self.features)
