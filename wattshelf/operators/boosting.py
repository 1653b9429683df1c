"""Boosted trees for several classes: softmax gradients, histograms of sparse features, one pass per level.

All classes grow their trees of a round together, so a level costs one pass over the rows whatever the number
of classes. Rows are held twice: as blocks of rows, which know the node of each row, and as parts of features, which hold
the rows of each bin. A round sends the class shares of the rows to the parts, a level their nodes (a byte per row and
class); a part sums gradients and Hessians per (class, node, feature, bin) on its own and finds the best split per node.
Sums are not shuffled; what reaches the driver is one split per node and part.

Where a task can hold all cells, classes are dealt to tasks in place of features: a round is one job, in which every task grows the
whole trees of its classes and returns them with the leaf of each row (a byte per row and class); the driver adds the leaves up.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattshelf.functions.columns import quoted
from wattshelf.session import materialise

BLOCK_SCHEMA = "n int, labels binary, rows binary, features binary, values binary"


@dataclass(frozen=True)
class BoostSettings:
    """``rows_per_block``, ``cells_per_part`` (at most) and ``least_cells`` (to give a part to a core) size the tasks; with up to
    ``whole_parts`` such parts and ``held_rows`` (rows times classes) a task grows whole trees. The others are the model's."""

    rounds: int = 200
    depth: int = 6
    step: float = 0.3
    l2: float = 1.0
    min_child_weight: float = 1.0
    max_bins: int = 64
    rows_per_block: int = 1024
    cells_per_part: int = 4_000_000
    least_cells: int = 50_000
    fold_rounds: int = 5
    whole_parts: int = 4
    held_rows: int = 8_000_000


def sparse_cells(features: str) -> tuple[Column, Column]:
    """Positions and values of a vector column, sparse or dense."""
    vector = F.unwrap_udt(quoted(features))
    every = F.sequence(F.lit(0), F.size(vector["values"]) - 1)
    return F.when(vector["type"] == 0, vector["indices"]).otherwise(every), vector["values"]


def pack_blocks(batches, rows_per_block: int):
    """Arrow batches of (label, indices, values) to one packed row per block."""
    for batch in (b.slice(at, rows_per_block) for b in batches for at in range(0, b.num_rows, rows_per_block)):
        label, indices, values = (batch.column(i) for i in range(3))
        sizes = np.diff(indices.offsets.to_numpy())
        rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        taken = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        used = taken != 0
        columns = [
            pa.array([len(label)], pa.int32()),
            *[
                pa.array([a.tobytes()], pa.binary())
                for a in (
                    label.to_numpy(zero_copy_only=False).astype(np.int32), rows[used],
                    indices.flatten().to_numpy(zero_copy_only=False).astype(np.int32)[used], taken[used],
                )
            ],
        ]
        names = [part.split()[0] for part in BLOCK_SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays(columns, names)


def bin_edges(cells: DataFrame, max_bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets per feature, values, rows per feature): a value's bin is 1 plus the number of its feature's edges at or below it.

    Edges are approximate quantiles of the non-zero values, all of them where there are at most ``max_bins``.
    At most features x bins numbers reach the driver.
    """
    shares = [i / max_bins for i in range(1, max_bins + 1)]
    rows = cells.groupBy("feature").agg(
        F.min("value").alias("low"), F.count(F.lit(1)).alias("n"), F.percentile_approx("value", shares, 100 * max_bins).alias("edges")
    ).collect()
    if any(row["low"] < 0 for row in rows):
        raise ValueError("features must not be negative")
    found = {row["feature"]: sorted({e for e in row["edges"] if e > row["low"]}) for row in rows}
    size = max(found, default=-1) + 1
    offsets, counts = np.zeros(max(size, 1) + 1, np.int64), np.zeros(max(size, 1), np.int64)
    for row in rows:
        offsets[row["feature"] + 1], counts[row["feature"]] = len(found[row["feature"]]), row["n"]
    return np.cumsum(offsets), np.array([e for f in sorted(found) for e in found[f]], np.float64), counts


def bins_of(features: np.ndarray, values: np.ndarray, offsets: np.ndarray, edges: np.ndarray) -> np.ndarray:
    low, high = offsets[features], offsets[features + 1]
    while (open_ := low < high).any():  # binary search inside each feature's edges
        middle = (low + high) // 2
        right = open_ & (edges[np.minimum(middle, len(edges) - 1)] <= values)
        low = np.where(right, middle + 1, low)
        high = np.where(open_ & ~right, middle, high)
    return (low - offsets[features] + 1).astype(np.int32)


def unpack_block(row, offsets: np.ndarray, edges: np.ndarray) -> tuple:
    """(labels, rows, features, bins, columns, starts): entries sorted by feature and bin."""
    labels = np.frombuffer(row["labels"], np.int32)
    rows, features = np.frombuffer(row["rows"], np.int32), np.frombuffer(row["features"], np.int32)
    values = np.frombuffer(row["values"], np.float64)
    bins = bins_of(features, values, offsets, edges)
    order = np.lexsort((rows, bins, features))
    features = features[order]
    columns, starts = np.unique(features, return_index=True)
    return labels, rows[order], features, bins[order], columns, np.append(starts, len(features))


def route(block: tuple, feature: np.ndarray, least: np.ndarray, inner: int) -> np.ndarray:
    """The node (heap position) that each row reaches in a tree's first ``inner`` positions."""
    labels, rows, _, bins, columns, starts = block
    node = np.zeros(len(labels), np.int32)
    for m in np.flatnonzero(feature[:inner] >= 0).tolist():
        here = node == m
        at = np.searchsorted(columns, feature[m])
        right = rows[:0]
        if at < len(columns) and columns[at] == feature[m]:
            part = slice(starts[at], starts[at + 1])
            right = rows[part][bins[part] >= least[m]]
            right = right[here[right]]
        node[here] = 2 * m + 1
        node[right] = 2 * m + 2
    return node


def add_trees(block: tuple, margins: np.ndarray, trees: list[tuple]) -> np.ndarray:
    """Margins (rows x classes) after further rounds; a round is (feature, least, value) with a row per class."""
    margins = margins.copy()
    for feature, least, value in trees:
        for k in range(margins.shape[1]):
            margins[:, k] += value[k][route(block, feature[k], least[k], feature.shape[1])]
    return margins


def summed(keys: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums per equal key of sorted keys."""
    if not len(keys):
        return keys, g, h
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(g, starts), np.add.reduceat(h, starts)


def shares_of(margins: np.ndarray) -> np.ndarray:
    p = np.exp(margins - margins.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def gradients(share: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the softmax loss by one class's margin (the second as 2 p (1 - p))."""
    return share - hit, np.maximum(2.0 * share * (1.0 - share), 1e-16)


def deal_cells(item: tuple, parts: int):
    """A block's labels to every part, its cells to the parts of their features."""
    at, (labels, rows, features, bins, _, _) = item
    part = features % parts
    for i in range(parts):
        here = part == i
        yield i, (at, labels, rows[here], features[here], bins[here])


def feature_part(index: int, items, rows_per_block: int):
    """One part: labels per block, rows of all cells sorted by feature and bin, and where each (feature, bin) begins."""
    dealt = sorted((value for _, value in items), key=lambda value: value[0])
    if not dealt:
        return
    rows = np.concatenate([at * rows_per_block + r.astype(np.int64) for at, _, r, _, _ in dealt])
    features, bins = (np.concatenate([value[i] for value in dealt]) for i in (3, 4))
    order = np.lexsort((rows, bins, features))
    features, bins = features[order], bins[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (features[1:] != features[:-1]) | (bins[1:] != bins[:-1])
    starts = np.flatnonzero(fresh)
    yield index, ("cells", {at: labels for at, labels, *_ in dealt}, rows[order], starts, features[starts].astype(np.int64), bins[starts].astype(np.int64))


def send_shares(state: tuple, trees: list[tuple], parts: int):
    at, block, margins = state
    message = ("shares", at, shares_of(add_trees(block, margins, trees)))
    return [(i, message) for i in range(parts)]


def send_nodes(state: tuple, current: tuple, level: int, parts: int):
    """The open node of the level that each row is in, per class (-1 for none)."""
    at, block, _ = state
    feature, least, open_nodes = current
    first = (1 << level) - 1
    nodes = np.full((len(feature), len(block[0])), -1, np.int16 if level > 6 else np.int8)
    for k in np.flatnonzero(open_nodes.any(1)).tolist():
        node = route(block, feature[k], least[k], first) - first
        nodes[k] = np.where((node >= 0) & open_nodes[k][np.maximum(node, 0)], node, -1)
    message = ("nodes", at, nodes)
    return [(i, message) for i in range(parts)]


def part_splits(items, level: int, open_nodes: np.ndarray, usable, width: int, settings: BoostSettings):
    """(splits, totals, usable) of one part, see ``best_splits``, for all classes.

    ``totals`` are the sums of whole nodes, which give what stands at value zero by difference. Below the root, ``usable`` names the
    features that can be a child.
    """
    cells, shares, inside = None, {}, {}
    for _, (kind, *value) in items:
        if kind == "cells":
            cells = value
        else:
            (shares if kind == "shares" else inside)[value[0]] = value[1]
    if cells is None:
        return
    labels, rows, starts, features, bins = cells
    nodes, size = 1 << level, settings.rows_per_block
    classes = len(open_nodes)
    n = (max(labels) + 1) * size
    cell = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows)))) if level else None
    all_splits, all_totals, all_columns = [], np.zeros((classes * nodes, 2)), []
    for k in np.flatnonzero(open_nodes.any(1)).tolist():
        g, h, node = np.zeros(n), np.zeros(n), np.full(n, -1, np.int16)
        for at, share in shares.items():
            here = slice(at * size, at * size + len(share))
            g[here], h[here] = gradients(share[:, k], labels[at] == k)
            node[here] = inside[at][k] if level else 0
        held = np.flatnonzero(node >= 0)
        totals = all_totals[k * nodes : (k + 1) * nodes]
        for i, values in enumerate((g, h)):
            totals[:, i] = np.bincount(node[held], values[held], nodes)
        if not len(rows):
            continue
        if level:
            chosen = np.flatnonzero(usable[k][features][cell])
            at = node[rows[chosen]]
            chosen, at = chosen[at >= 0], at[at >= 0]
            order = np.argsort(at, kind="stable")
            chosen, at = chosen[order], at[order].astype(np.int64)
            of, r = cell[chosen], rows[chosen]
            sums = summed(((k * nodes + at) * width + features[of]) * 256 + bins[of], g[r], h[r])
        else:
            sums = (k * width + features) * 256 + bins, np.add.reduceat(g[rows], starts), np.add.reduceat(h[rows], starts)
        splits, _, columns = best_splits((*sums, all_totals), width, settings.l2, settings.min_child_weight)
        all_splits += splits
        if not level:
            all_columns.append(columns)
    yield all_splits, all_totals, np.concatenate(all_columns) if all_columns else np.empty(0, np.int64)


def best_splits(sums: tuple, width: int, l2: float, min_child_weight: float) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """(splits, totals, usable): per node the split of highest gain in this part, ties to the lowest feature and bin.

    A split sends values in ``bin`` or above to the right. ``usable`` are the (node, feature) pairs whose non-zero values
    weigh enough to be a child.
    """
    keys, g, h, totals = sums
    if not len(keys):
        return [], totals, np.empty(0, np.int64)
    column = keys // 256
    node = column // width
    last = np.flatnonzero(np.concatenate([column[1:] != column[:-1], [True]]))
    ends = np.repeat(last, np.diff(last, prepend=-1))
    g_upto, h_upto = np.cumsum(g), np.cumsum(h)
    right_g, right_h = g_upto[ends] - g_upto + g, h_upto[ends] - h_upto + h
    all_g, all_h = totals[node, 0], totals[node, 1]
    left_g, left_h = all_g - right_g, all_h - right_h
    valid = np.flatnonzero((right_h >= min_child_weight) & (left_h >= min_child_weight))
    gain = np.zeros(len(keys))
    left, right, whole = ((x[valid] ** 2 / (y[valid] + l2)) for x, y in ((left_g, left_h), (right_g, right_h), (all_g, all_h)))
    gain[valid] = left + right - whole
    gain[gain <= 1e-6] = 0.0
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    best = np.maximum.reduceat(gain, starts)
    # equal splits differ by the order of sums only: the first within one part in 10^9 of the best
    near = np.flatnonzero((gain > 0) & (gain >= np.repeat(best, np.diff(np.append(starts, len(keys)))) * (1 - 1e-9)))
    top = near[np.concatenate([[True], node[near][1:] != node[near][:-1]])] if len(near) else near
    splits = [
        (int(node[i]), float(gain[i]), int(column[i] % width), int(keys[i] % 256), left_g[i], left_h[i], right_g[i], right_h[i]) for i in top.tolist()
    ]
    first = np.concatenate([[0], last[:-1] + 1])
    weights = h_upto[last] - h_upto[first] + h[first]
    return splits, totals, column[last][weights >= min_child_weight]


def merged_splits(found) -> dict[int, tuple]:
    """The best split per node from the splits of all parts, ties to the lowest feature and bin."""
    best: dict[int, tuple] = {}
    for splits in found:
        for split in splits:
            held = best.get(split[0])
            if held is None or split[1] > held[1] * (1 + 1e-9) or (split[1] >= held[1] * (1 - 1e-9) and split[2:4] < held[2:4]):
                best[split[0]] = split
    return best


def write_splits(best: dict[int, tuple], tree: tuple, nodes: int, settings: BoostSettings) -> np.ndarray:
    """Enter a level's splits into the trees (feature, least, value); the open nodes of the next level per class."""
    feature, least, value = tree
    open_nodes = np.zeros((len(feature), 2 * nodes), bool)
    for node, (_, _, f, b, left_g, left_h, right_g, right_h) in best.items():
        k, at = divmod(node, nodes)
        m = nodes - 1 + at
        feature[k, m], least[k, m] = f, b
        value[k, 2 * m + 1] = -settings.step * left_g / (left_h + settings.l2)
        value[k, 2 * m + 2] = -settings.step * right_g / (right_h + settings.l2)
        open_nodes[k, 2 * at : 2 * at + 2] = True
    return open_nodes


def fresh_trees(classes: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inner, size = (1 << depth) - 1, (1 << (depth + 1)) - 1
    return np.full((classes, inner), -1, np.int32), np.zeros((classes, inner), np.int32), np.zeros((classes, size))


def contenders(node: np.ndarray, g: np.ndarray, size: np.ndarray, h: np.ndarray, totals: np.ndarray, settings: BoostSettings) -> np.ndarray:
    """Which (node, feature) pairs can hold the best split of their node, from sums of gradients, their sizes and Hessians of non-zero values.

    The split between zero and non-zero values is one that a node has; no cut of a feature gains more than a right side of all its positive or
    all its negative gradients and the least weight would.
    """
    l2, least = settings.l2, settings.min_child_weight
    all_g, all_h = totals[node, 0], totals[node, 1]
    whole = all_g**2 / (all_h + l2)
    known = g**2 / (h + l2) + (all_g - g) ** 2 / (np.maximum(all_h - h, 0) + l2) - whole
    known[(h < least * (1 + 1e-9)) | (all_h - h < least * (1 + 1e-9))] = 0.0
    best = np.zeros(len(totals))
    np.maximum.at(best, node, known)
    rest = np.maximum(all_h - h, least) + l2
    most = np.full(len(node), -np.inf)
    for right in ((size + g) / 2, (g - size) / 2):
        most = np.maximum(most, right**2 / (least + l2) + (all_g - right) ** 2 / rest - whole)
    return most >= best[node] * (1 - 1e-6)


class HeldCells:
    """All cells of a task in order of (feature, bin): ``rows``, counted without gaps, ``starts`` of each (feature, bin) pair, its ``column``
    and bin; the feature of each column in ``columns``, its pairs from ``first``."""

    def __init__(self, label: np.ndarray, rows: np.ndarray, starts: np.ndarray, column: np.ndarray, bins: np.ndarray, columns: np.ndarray, first: np.ndarray):
        self.label, self.rows, self.starts, self.column, self.bins, self.columns, self.first = label, rows, starts, column, bins, columns, first
        self.begin, self.end = starts[first[:-1]], starts[first[1:]]

    def root(self, h: np.ndarray, least: float) -> tuple:
        """(rows, (feature, bin) pairs, Hessians) of the features that weigh enough to be a child."""
        if not len(self.rows):
            return self.rows, np.empty(0, np.int32), np.empty(0)
        heavy = h[self.rows]
        usable = np.add.reduceat(heavy, self.begin) >= least
        pairs = np.flatnonzero(usable[self.column]).astype(np.int32)
        pairs = np.repeat(pairs, self.starts[pairs + 1] - self.starts[pairs])
        if usable.all():
            return self.rows, pairs, heavy
        inside = np.repeat(usable, self.end - self.begin)
        return self.rows[inside], pairs, heavy[inside]

    def below(self, rows: np.ndarray, pairs: np.ndarray, node: np.ndarray, h: np.ndarray, least: float) -> tuple:
        """(rows, pairs, Hessians, nodes) in order of (node, feature, bin): what is left of the level above."""
        at = node[rows]
        order = np.argsort(at, kind="stable")
        order = order[np.searchsorted(at, 0, sorter=order) :]
        at, rows, pairs = at[order], rows[order], pairs[order]
        heavy = h[rows]
        if not len(rows):
            return rows, pairs, heavy, at
        column = self.column[pairs]
        first = np.flatnonzero(np.concatenate([[True], (column[1:] != column[:-1]) | (at[1:] != at[:-1])]))
        usable = np.add.reduceat(heavy, first) >= least
        if not usable.all():
            inside = np.repeat(usable, np.diff(np.append(first, len(rows))))
            rows, pairs, heavy, at = rows[inside], pairs[inside], heavy[inside], at[inside]
        return rows, pairs, heavy, at

    def sums(self, rows: np.ndarray, pairs: np.ndarray, heavy: np.ndarray, at: np.ndarray | None, g: np.ndarray, totals: np.ndarray, width: int, settings: BoostSettings) -> tuple:
        """(keys, gradients, Hessians) per (node, feature, bin) of the features that may hold their node's best split."""
        if not len(rows):
            return np.empty(0, np.int64), np.empty(0), np.empty(0)
        slope, column = g[rows], self.column[pairs]
        fresh = column[1:] != column[:-1]
        if at is not None:
            fresh |= at[1:] != at[:-1]
        run = np.flatnonzero(np.concatenate([[True], fresh]))
        node = np.zeros(len(run), np.int64) if at is None else at[run].astype(np.int64)
        chosen = contenders(node, *(np.add.reduceat(a, run) for a in (slope, np.abs(slope), heavy)), totals, settings)
        if not chosen.all():
            inside = np.flatnonzero(np.repeat(chosen, np.diff(np.append(run, len(rows)))))
            pairs, slope, heavy = pairs[inside], slope[inside], heavy[inside]
            at = None if at is None else at[inside]
        fresh = pairs[1:] != pairs[:-1]
        if at is not None:
            fresh |= at[1:] != at[:-1]
        first = np.flatnonzero(np.concatenate([[True], fresh]))
        pair = pairs[first]
        keys = (0 if at is None else at[first].astype(np.int64) * width) + self.columns[self.column[pair]]
        return keys * 256 + self.bins[pair], np.add.reduceat(slope, first), np.add.reduceat(heavy, first)

    def right_of(self, feature: int, least: int) -> np.ndarray:
        """The rows whose value of a feature is in bin ``least`` or above."""
        at = int(np.searchsorted(self.columns, feature))
        low, high = self.first[at], self.first[at + 1]
        return self.rows[self.starts[low + np.searchsorted(self.bins[low:high], least)] : self.starts[high]]


def whole_cells(items, rows_per_block: int):
    """A part that has all features, as ``HeldCells`` takes it."""
    for index, (_, labels, rows, starts, features, bins) in items:
        label = np.full((max(labels) + 1) * rows_per_block, -1, np.int32)
        for at, found in labels.items():
            label[at * rows_per_block : at * rows_per_block + len(found)] = found
        number = np.cumsum(label >= 0) - 1  # blocks may be short
        first = np.flatnonzero(np.diff(features, prepend=-1))
        column = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(features))))
        starts = np.append(starts, len(rows)).astype(np.int32)
        yield index, (label[label >= 0], number[rows].astype(np.int32), starts, column, bins.astype(np.uint8), features[first], np.append(first, len(features)))


def class_tree(cells: HeldCells, k: int, share: np.ndarray, width: int, settings: BoostSettings) -> tuple:
    """(feature, least, value, leaf of each row) of a round's tree for class ``k``."""
    g, h = gradients(share, cells.label == k)
    limit = settings.min_child_weight * (1 - 1e-9)  # a little below: sums differ by their order
    tree = fresh_trees(1, settings.depth)
    tree[2][0, 0] = -settings.step * g.sum() / (h.sum() + settings.l2)
    place = np.zeros(len(share), np.int8 if settings.depth < 7 else np.int16 if settings.depth < 15 else np.int32)
    left: tuple = ()
    for level in range(settings.depth):
        nodes = 1 << level
        node = place - place.dtype.type(nodes - 1)
        node[node < 0] = -1
        inside = np.flatnonzero(node >= 0)
        totals = np.stack([np.bincount(node[inside], values[inside], nodes) for values in (g, h)], 1)
        *left, heavy, at = cells.below(*left, node, h, limit) if level else (*cells.root(h, limit), None)
        sums = cells.sums(*left, heavy, at, g, totals, width, settings)
        best = merged_splits([best_splits((*sums, totals), width, settings.l2, settings.min_child_weight)[0]])
        if not best:
            break
        write_splits(best, tree, nodes, settings)
        right = np.zeros(len(share), bool)
        for m, (_, _, f, b, *_) in best.items():
            rows = cells.right_of(f, b)
            right[rows[node[rows] == m]] = True
        moved = inside[tree[0][0, place[inside]] >= 0]
        place[moved] = 2 * place[moved] + 1 + right[moved]
    return tree[0][0], tree[1][0], tree[2][0], place


def class_trees(items, shares, width: int, copies: int, settings: BoostSettings):
    """(class, tree) for the classes of a task; ``shares`` are broadcast (classes x rows)."""
    for index, found in items:
        cells = HeldCells(*found)
        for k in range(index, len(shares.value), copies):
            yield k, class_tree(cells, k, shares.value[k], width, settings)


def rounds_of_classes(held: RDD, n: int, width: int, classes: int, copies: int, settings: BoostSettings) -> list[tuple]:
    """All rounds, a job each; rows count as ``whole_cells`` counts them."""
    margins, done = np.zeros((classes, n)), []
    for _ in range(settings.rounds):
        shares = held.context.broadcast(np.ascontiguousarray(shares_of(margins.T).T))
        found = dict(held.mapPartitions(lambda items: class_trees(items, shares, width, copies, settings)).collect())  # noqa: B023
        shares.destroy()
        for k in range(classes):
            margins[k] += found[k][2][found[k][3]]
        done.append(tuple(np.stack([found[k][i] for k in range(classes)]) for i in range(3)))
    held.unpersist()
    return done


@dataclass(frozen=True)
class SoftmaxTrees:
    """Trees of all rounds: arrays (round, class, position) of feature (-1 for a leaf), cut and leaf value.

    A row goes right where its feature's value is at or above the cut.
    """

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def margins(self, rows: np.ndarray, features: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """Sums of leaf values (rows x classes) for sparse cells."""
        rounds, classes, inner = self.feature.shape
        used, place = np.unique(np.maximum(self.feature, 0), return_inverse=True)
        place = place.reshape(rounds * classes, inner)
        leaf = self.feature.reshape(rounds * classes, inner) < 0
        cut, value = self.cut.reshape(rounds * classes, inner), self.value.reshape(rounds * classes, -1)
        trees = np.arange(rounds * classes)
        out = np.zeros((n, classes))
        at = np.searchsorted(used, features)
        known = (at < len(used)) & (used[np.minimum(at, len(used) - 1)] == features)
        rows, at, values = rows[known], at[known], values[known]
        for start in range(0, n, 512):
            end = min(n, start + 512)
            low, high = np.searchsorted(rows, [start, end])
            dense = np.zeros((end - start, len(used)))
            dense[rows[low:high] - start, at[low:high]] = values[low:high]
            node = np.zeros((end - start, rounds * classes), np.int64)
            for _ in range(int(math.log2(inner + 1))):
                inside = node < inner
                m = np.where(inside, node, 0)
                stop = ~inside | leaf[trees, m]
                right = dense[np.arange(end - start)[:, None], place[trees, m]] >= cut[trees, m]
                node = np.where(stop, node, 2 * node + 1 + right)
            out[start:end] = value[trees, node].reshape(end - start, rounds, classes).sum(1)
        return out

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Add ``probability`` (an array per row) and ``prediction`` (the class of the highest, first on ties)."""
        model = self

        @F.pandas_udf("array<double>")
        def shares(indices: pd.Series, values: pd.Series) -> pd.Series:
            sizes = [len(i) for i in indices]
            n = len(sizes)
            flat = [np.concatenate([np.asarray(a, kind) for a in side]) if n else np.empty(0) for side, kind in ((indices, np.int64), (values, np.float64))]
            margins = model.margins(np.repeat(np.arange(n), sizes), *flat, n)
            p = np.exp(margins - margins.max(1, keepdims=True))
            return pd.Series(list(p / p.sum(1, keepdims=True)))

        scored = df.withColumn("probability", shares(*sparse_cells(features)))
        best = F.array_position("probability", F.array_max("probability")) - 1
        return scored.withColumn("prediction", best.cast("double"))

    def rows(self, spark) -> DataFrame:
        """The trees as a table for storage: tree, round, class, feature, cut, value."""
        rounds, classes, _ = self.feature.shape
        data = [
            (r, k, self.feature[r, k].tolist(), self.cut[r, k].tolist(), self.value[r, k].tolist()) for r in range(rounds) for k in range(classes)
        ]
        return spark.createDataFrame(data, "round int, class int, feature array<int>, cut array<double>, value array<double>")

    @staticmethod
    def from_rows(stored: DataFrame) -> SoftmaxTrees:
        rows = sorted(stored.collect(), key=lambda r: (r["round"], r["class"]))
        shape = (rows[-1]["round"] + 1, rows[-1]["class"] + 1, -1)
        return SoftmaxTrees(
            *[np.array([r[name] for r in rows], kind).reshape(shape) for name, kind in (("feature", np.int32), ("cut", np.float64), ("value", np.float64))]
        )


def binned_blocks(train: DataFrame, features: str, label: str, settings: BoostSettings) -> tuple[RDD, np.ndarray, np.ndarray, np.ndarray, int, int]:
    """(numbered blocks, offsets, edges, cells per feature, classes, rows): the rows, binned once and held by the executors (lost ones are read again)."""
    spark = train.sparkSession
    indices, values = sparse_cells(features)
    flat = train.select(quoted(label).cast("int").alias("label"), indices.alias("indices"), values.alias("values"))
    rows = flat.agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("top")).first()
    if not rows["n"]:
        raise ValueError("no rows to train on")
    parts = -(-rows["n"] // settings.rows_per_block)
    packed = materialise(
        flat.repartition(parts).mapInArrow(partial(pack_blocks, rows_per_block=settings.rows_per_block), BLOCK_SCHEMA), "boost-blocks"
    )
    zipped = flat.select(F.explode(F.arrays_zip("indices", "values")).alias("c"))
    cells = zipped.select(F.col("c.indices").alias("feature"), F.col("c.values").alias("value")).filter("value <> 0")
    offsets, edges, counts = bin_edges(cells, settings.max_bins)
    shared = spark.sparkContext.broadcast((offsets, edges))
    numbered = packed.rdd.zipWithIndex().map(lambda pair: (pair[1], pair[0]))
    spread = min(packed.count(), max(spark.sparkContext.defaultParallelism, -(-int(counts.sum()) // settings.cells_per_part)))
    blocks = numbered.partitionBy(spread).map(lambda pair: (pair[0], unpack_block(pair[1], *shared.value)))
    return blocks, offsets, edges, counts, rows["top"] + 1, rows["n"]


def fit_softmax_trees(
    train: DataFrame, settings: BoostSettings | None = None, features: str = "features", label: str = "label_index"
) -> SoftmaxTrees:
    """Boosted trees with softmax loss; ``label`` counts from 0, absent features are zero, values must not be negative.

    Every round adds a tree per class. Rows are held as binned blocks and as parts of features; margins are folded into the
    blocks every ``fold_rounds`` rounds, always from the stored blocks, so the lineage stays short. Empty vectors are allowed; rows that
    repeat count each; no rows at all is an error.
    """
    settings = settings or BoostSettings()
    context = train.sparkSession.sparkContext
    blocks, offsets, edges, counts, classes, n = binned_blocks(train, features, label, settings)
    width, cells = len(counts), int(counts.sum())
    parts = max(1, -(-cells // settings.cells_per_part), min(context.defaultParallelism, -(-cells // settings.least_cells)))
    whole = cells <= settings.whole_parts * settings.cells_per_part and n * classes <= settings.held_rows
    if whole:
        parts = 1
    copies = min(classes, context.defaultParallelism) if whole else parts
    dealt = blocks.flatMap(lambda b: ((i, value) for _, value in deal_cells(b, 1) for i in range(copies)) if whole else deal_cells(b, parts))
    by_feature = dealt.partitionBy(copies).mapPartitionsWithIndex(
        partial(feature_part, rows_per_block=settings.rows_per_block), preservesPartitioning=True
    )
    if whole:
        held = by_feature.mapPartitions(partial(whole_cells, rows_per_block=settings.rows_per_block)).persist(StorageLevel.MEMORY_AND_DISK)
        done = rounds_of_classes(held, n, width, classes, copies, settings)
    else:
        done = rounds_of_jobs(blocks, by_feature.persist(StorageLevel.MEMORY_AND_DISK), parts, width, classes, settings)
    feature, least, value = (np.stack([tree[i] for tree in done]) for i in range(3))
    cut = np.full(feature.shape, np.nextafter(0.0, 1.0))
    inside = (feature >= 0) & (least > 1)
    cut[inside] = edges[offsets[feature[inside]] + least[inside] - 2]
    return SoftmaxTrees(feature, cut, value)


def rounds_of_jobs(blocks: RDD, by_feature: RDD, parts: int, width: int, classes: int, settings: BoostSettings) -> list[tuple]:
    """All rounds, a job per level, where the parts cannot all stay in tasks of their own."""
    done: list[tuple] = []

    def folded() -> RDD:
        trees = list(done)
        return blocks.map(lambda b: (*b, add_trees(b[1], np.zeros((len(b[1][0]), classes)), trees))).persist(StorageLevel.MEMORY_AND_DISK)

    state, upto = folded(), 0
    for round_ in range(settings.rounds):
        if round_ - upto >= settings.fold_rounds:
            state.unpersist()
            state, upto = folded(), round_
        feature, least, value = fresh_trees(classes, settings.depth)
        open_nodes, usable, recent = np.ones((classes, 1), bool), None, done[upto:]
        # parts meet shares and nodes where they are: all three are dealt alike
        shares = by_feature.union(state.flatMap(lambda s: send_shares(s, recent, parts)).partitionBy(parts))  # noqa: B023
        for level in range(settings.depth):
            if not open_nodes.any():
                break
            current, nodes = (feature, least, open_nodes), 1 << level
            sent = state.flatMap(lambda s: send_nodes(s, current, level, parts)).partitionBy(parts) if level else None  # noqa: B023
            met = shares.union(sent) if level else shares
            found = met.mapPartitions(lambda items: part_splits(items, level, open_nodes, usable, width, settings)).collect()  # noqa: B023
            if level == 0:
                usable = np.zeros((classes, width), bool)
                for _, _, columns in found:
                    usable[columns // width, columns % width] = True
                for k in range(classes):
                    value[k, 0] = -settings.step * found[0][1][k, 0] / (found[0][1][k, 1] + settings.l2)
            open_nodes = write_splits(merged_splits(splits for splits, _, _ in found), (feature, least, value), nodes, settings)
        done.append((feature, least, value))
    state.unpersist()
    by_feature.unpersist()
    return done
