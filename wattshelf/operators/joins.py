"""Joins on order: the latest row as of a time, and values inside intervals, without a key or a range in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattshelf.functions.columns import finite, quoted
from wattshelf.functions.series import micros
from wattshelf.operators.ranks import MAX_BINS, bins_for, profile_columns, with_bin

#: Intervals that a point is held against, about, while their number needs no more than ``MAX_BINS`` bins.
INTERVALS_PER_BIN = 16


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    take: Sequence[str],
    tiebreak: Sequence[str] = (),
    tolerance_us: int | None = None,
    rows_per_block: int = 1_000_000,
) -> DataFrame:
    """Every left row with columns ``take`` of the latest right row of its keys at or before its time, else nulls.

    Both sides are laid in one order and the last right row is carried on: inside blocks of about equal depth of
    time, and from block to block by one row per (keys, block). So a key with most of the rows is spread over blocks.
    Of right rows at one time, the largest by ``tiebreak`` counts; one that is older than ``tolerance_us`` does not. Null
    keys and times match nothing; right rows may be used by any number of left rows, and left rows that repeat stay.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    own = [quoted(k).alias(n) for k, n in zip(keys, names)]
    rest = F.struct(*[quoted(c).alias(c) for c in left.columns])
    found = F.struct(*[quoted(c).alias(c) for c in take], micros(quoted(right_time)).alias("_found_at"))
    right = right.filter(quoted(right_time).isNotNull())
    for key in keys:
        right = right.filter(quoted(key).isNotNull())
    order = F.struct(*[quoted(c).alias(f"t{i}") for i, c in enumerate(tiebreak)], F.lit(0).alias("_last"))
    at = lambda time: micros(quoted(time)).cast("double").alias("_at")
    lefts = left.select(*own, at(left_time), F.lit(1).alias("_side"), rest.alias("_left"))
    rights = right.select(*own, at(right_time), F.lit(0).alias("_side"), order.alias("_tie"), found.alias("_right"))
    both = lefts.unionByName(rights, allowMissingColumns=True)

    blocks = max(1, math.ceil(both.count() / rows_per_block))
    edges = profile_columns(both, ["_at"], blocks)["_at"].edges if blocks > 1 else ()
    placed = with_bin(both, "_at", edges, "_block")
    inside = Window.partitionBy(*names, "_block").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.max_by(F.col("_right"), F.when(F.col("_side") == 0, F.struct("_at", "_tie")))
    ends = placed.groupBy(*names, "_block").agg(latest.alias("_end"))
    earlier = Window.partitionBy(*names).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *[F.col(n).alias(f"{n}_of") for n in names], F.col("_block").alias("_block_of"), F.last("_end", ignorenulls=True).over(earlier).alias("_carried")
    )
    same = F.col("_block") == F.col("_block_of")
    for name in names:
        same = same & F.col(name).eqNullSafe(F.col(f"{name}_of"))
    seen = placed.withColumn("_seen", F.last("_right", ignorenulls=True).over(inside)).filter("_side = 1")
    match = F.coalesce("_seen", "_carried")
    if tolerance_us is not None:
        match = F.when(F.col("_at") - match["_found_at"] <= tolerance_us, match)
    joined = seen.join(carried, same).withColumn("_match", match)
    return joined.select("_left.*", *[F.col("_match")[c].alias(c) for c in take])


def interval_bins(rows: int, intervals: int) -> int:
    """Bins for a join of points and intervals: as many as keep both the points and the intervals of one few."""
    return max(bins_for(rows), min(MAX_BINS, math.ceil(intervals / INTERVALS_PER_BIN)))


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    value: str | Column,
    low: str | Column,
    high: str | Column,
    bins: int | None = None,
) -> DataFrame:
    """Pairs of a point and an interval with low <= value <= high, all columns of both.

    An equi-join on bins: edges of about equal depth cut the values, each interval is repeated for the bins that it
    covers (``bins`` of them at most), each point has one; the bounds are tested after, for each pair in a bin, so the bins
    grow with the intervals. A null bound is open; null and NaN values, and intervals that end before they start, match nothing.
    """
    as_column = lambda c: (quoted(c) if isinstance(c, str) else c).cast("double")
    keyed = points.withColumn("_value", finite(as_column(value)))
    rows = keyed.count()
    edges = profile_columns(keyed, ["_value"], bins or interval_bins(rows, intervals.count()))["_value"].edges if rows else ()
    binned = with_bin(keyed.filter(F.col("_value").isNotNull()), "_value", edges, "_bin")
    bounded = intervals.withColumns(
        {"_low": F.coalesce(as_column(low), F.lit(-math.inf)), "_high": F.coalesce(as_column(high), F.lit(math.inf))}
    ).filter("_low <= _high")
    placed = with_bin(with_bin(bounded, "_low", edges, "_from"), "_high", edges, "_to")
    spread = placed.withColumn("_cell", F.explode(F.sequence("_from", "_to")))
    inside = (F.col("_bin") == F.col("_cell")) & (F.col("_value") >= F.col("_low")) & (F.col("_value") <= F.col("_high"))
    return binned.join(spread, inside).drop("_value", "_bin", "_low", "_high", "_from", "_to", "_cell")
