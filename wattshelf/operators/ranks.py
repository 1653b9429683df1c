"""Exact order statistics and row numbers without a global sort or a single-task window.

Two bounded facts about a numeric column reach the driver: approximate quantiles that cut it
into bins of nearly equal depth, and the number of rows in each bin. The bins are used as
range partitions of known size; the exact answer comes from the bin that holds it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattshelf.functions.columns import finite, quoted

MIN_BINS, MAX_BINS = 256, 16_384
ROWS_PER_BIN = 500_000
SAMPLE_PER_BIN = 200
MAX_BLOCKS = 8192


BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint only for a side whose row count is known and small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass(frozen=True)
class Hit:
    """The value at a rank, the rows below it and the rows equal to it."""

    value: float
    below: int
    equal: int


@dataclass(frozen=True)
class Profile:
    """Non-missing row count, range and bin edges of one numeric column."""

    count: int
    low: float | None
    high: float | None
    edges: tuple[float, ...]


def bins_for(rows: int) -> int:
    """Enough bins that the one holding an answer stays small for a task, up to 10**10 rows."""
    return min(MAX_BINS, max(MIN_BINS, rows // ROWS_PER_BIN))


def profile_columns(df: DataFrame, columns: Sequence[str], bins: int | None = None) -> dict[str, Profile]:
    """Counts and ranges from all rows, bin edges from a sample; missing, NaN and infinite values are left out.

    Edges only have to make bins of about equal depth, as ranks are then counted exactly. So they come from
    about ``SAMPLE_PER_BIN`` rows per bin, and what meets in the task that merges them does not grow with
    the number of rows.
    """
    values = [finite(quoted(name)) for name in columns]
    exact = [F.count(F.lit(1)).alias("rows")]
    for i, value in enumerate(values):
        exact += [F.count(value).alias(f"n{i}"), F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}")]
    row = df.agg(*exact).first()
    bins = bins or bins_for(row["rows"])
    shares = [i / bins for i in range(1, bins)]
    part = min(1.0, SAMPLE_PER_BIN * bins / max(row["rows"], 1))
    sketches = [F.percentile_approx(value, shares, 10 * bins).alias(f"q{i}") for i, value in enumerate(values)]
    edges = df.sample(fraction=part, seed=bins).agg(*sketches).first()
    return {
        name: Profile(row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"], tuple(sorted(set(edges[f"q{i}"] or ()))))
        for i, name in enumerate(columns)
    }


def with_bin(df: DataFrame, column: str, edges: Sequence[float], output: str) -> DataFrame:
    """The number of edges at or below the value, found by binary search in the JVM.

    A missing value gets bin -1, so that no row is lost where the bin is a join key.
    """
    missing = quoted(column).isNull()
    if not edges:
        return df.withColumn(output, F.when(missing, -1).otherwise(0))
    splits = [-math.inf, *edges, math.inf]
    bucketizer = Bucketizer(splits=splits, inputCol=column, outputCol=output, handleInvalid="keep")
    binned = bucketizer.transform(df)
    return binned.withColumn(output, F.when(missing, -1).otherwise(F.coalesce(F.col(output).cast("int"), F.lit(-1))))


def values_at_ranks(
    df: DataFrame,
    ranks: Mapping[str, Sequence[int]],
    profiles: Mapping[str, Profile] | None = None,
) -> dict[str, list[float | None]]:
    """The values at 0-based ranks of each column's ascending order; null past the end."""
    hits = hits_at_ranks(df, ranks, profiles)
    return {name: [hit and hit.value for hit in hits[name]] for name in ranks}


def hits_at_ranks(
    df: DataFrame,
    ranks: Mapping[str, Sequence[int]],
    profiles: Mapping[str, Profile] | None = None,
) -> dict[str, list[Hit | None]]:
    """What stands at 0-based ranks of each column's ascending order; null past the end.

    A fixed number of jobs for any number of columns and ranks: the row count, the profile, the
    bin counts, and the value counts inside the few bins that hold a rank.
    """
    columns = list(ranks)
    profiles = profiles or profile_columns(df, columns)
    numbers = df.select(*[finite(quoted(name)).alias(f"v{i}") for i, name in enumerate(columns)])
    for i, name in enumerate(columns):
        numbers = with_bin(numbers, f"v{i}", profiles[name].edges, f"b{i}")
    cells = numbers.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("c"), F.col(f"b{i}").alias("b"), F.col(f"v{i}").alias("v"))
                    for i in range(len(columns))
                ]
            )
        ).alias("cell")
    ).select("cell.*").filter(F.col("v").isNotNull())

    depth: dict[int, dict[int, int]] = {i: {} for i in range(len(columns))}
    for row in cells.groupBy("c", "b").count().collect():
        depth[row["c"]][row["b"]] = row["count"]

    wanted: dict[tuple[int, int], dict[int, int]] = {}
    for i, name in enumerate(columns):
        for rank in ranks[name]:
            if not 0 <= rank < profiles[name].count:
                continue
            before = 0
            for b in sorted(depth[i]):
                if rank < before + depth[i][b]:
                    wanted.setdefault((i, b), {})[rank] = rank - before
                    break
                before += depth[i][b]
    found: dict[tuple[int, int], Hit] = {}
    if wanted:
        spark = df.sparkSession
        targets = spark.createDataFrame(
            [(i, b, rank, local) for (i, b), local_ranks in wanted.items() for rank, local in local_ranks.items()],
            "c int, b int, rank bigint, local bigint",
        )
        inside = cells.filter(F.struct("c", "b").isin(*[F.struct(F.lit(i), F.lit(b)) for i, b in wanted]))
        counted = inside.groupBy("c", "b", "v").count()
        running = Window.partitionBy("c", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        spans = counted.withColumn("upto", F.sum("count").over(running))
        hits = spans.join(F.broadcast(targets), ["c", "b"]).filter(
            (F.col("local") < F.col("upto")) & (F.col("local") >= F.col("upto") - F.col("count"))
        )
        for row in hits.collect():
            below = row["rank"] - row["local"] + row["upto"] - row["count"]
            found[row["c"], row["rank"]] = Hit(row["v"], below, row["count"])
    return {name: [found.get((i, rank)) for rank in ranks[name]] for i, name in enumerate(columns)}


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], shares: Sequence[float]
) -> tuple[dict[str, list[float]], dict[str, Profile]]:
    """Linearly interpolated quantiles of each column (none for an empty one), with the profiles."""
    profiles = profile_columns(df, columns)
    positions = {
        name: [(profiles[name].count - 1) * share for share in shares] if profiles[name].count else []
        for name in columns
    }
    ranks = {
        name: sorted({rank for p in positions[name] for rank in (math.floor(p), math.ceil(p))}) for name in columns
    }
    values = values_at_ranks(df, ranks, profiles)
    result = {}
    for name in columns:
        at = dict(zip(ranks[name], values[name], strict=True))
        result[name] = [
            at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p))
            for p in positions[name]
        ]
    return result, profiles


def with_ordinals(
    df: DataFrame,
    order: Column,
    tiebreak: Sequence[Column] = (),
    series: Sequence[str] = (),
    output: str = "ordinal",
    rows_per_block: int = 1_000_000,
) -> DataFrame:
    """1-based row numbers per series by a numeric order column, balanced under skew.

    Equal-depth cuts of the order column bound the rows of every (series, block) pair, however
    much of the data one series or one period holds; a block's offset is the running count of
    the blocks before it. ``order`` plus ``tiebreak`` must be unique within a series.
    """
    keyed = df.withColumn("_order", order.cast("double"))
    rows = df.count()
    blocks = max(1, min(MAX_BLOCKS, math.ceil(rows / rows_per_block)))
    edges = profile_columns(keyed, ["_order"], blocks)["_order"].edges if blocks > 1 else ()
    keyed = with_bin(keyed, "_order", edges, "_block")
    keys = [quoted(name) for name in series]
    by_series = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_block")
    before = by_series.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*keys, "_block")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    renamed = offsets.select(
        *[quoted(name).alias(f"_k{i}") for i, name in enumerate(series)],
        F.col("_block").alias("_kb"),
        "_offset",
    )
    match = F.col("_block") == F.col("_kb")
    for i, name in enumerate(series):
        match = match & quoted(name).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_block").orderBy("_order", *tiebreak)
    helper = ["_order", "_block", "_kb", "_offset", *[f"_k{i}" for i in range(len(series))]]
    return (
        keyed.join(renamed, match)
        .withColumn(output, F.col("_offset") + F.row_number().over(inside))
        .drop(*helper)
    )


def windowed_in_blocks(
    df: DataFrame,
    order: Column,
    halo: int,
    make_columns,
    tiebreak: Sequence[Column] = (),
    series: Sequence[str] = (),
    rows_per_block: int = 1_000_000,
) -> DataFrame:
    """Window columns that look back at most ``halo`` rows, with bounded work per task.

    Where every series has at most ``rows_per_block`` rows, this is one window per series and
    one shuffle. Otherwise each series is cut into runs of that many consecutive rows; the last
    ``halo`` rows of a run are also sent to the next run and dropped again after the window.
    ``make_columns`` gets the window (partitioned and ordered) and returns name -> column.
    """
    keys = [quoted(name) for name in series]
    longest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if longest <= rows_per_block:
        whole = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order.cast("double"), *tiebreak)
        return df.withColumns(make_columns(whole))
    run = max(rows_per_block, halo, 1)
    numbered = with_ordinals(df, order, tiebreak, series, "_ordinal", rows_per_block)
    at = F.col("_ordinal") - 1
    own = F.struct(F.floor(at / run).alias("run"), F.lit(False).alias("halo"))
    next_run = F.struct((F.floor(at / run) + 1).alias("run"), F.lit(True).alias("halo"))
    copies = F.when(at % run >= run - halo, F.array(own, next_run)).otherwise(F.array(own))
    spread = numbered.withColumn("_copy", F.explode(copies))
    window = Window.partitionBy(*keys, F.col("_copy.run")).orderBy("_ordinal")
    return (
        spread.withColumns(make_columns(window))
        .filter(~F.col("_copy.halo"))
        .drop("_copy", "_ordinal")
    )


def dense_index(df: DataFrame, order: Sequence[Column], output: str) -> DataFrame:
    """0-based positions in a total order of any type, through a range-partitioned sort.

    The sorted rows are written once to the shared folder, so that the partition sizes and the
    rows numbered from them are the same even when tasks are retried.
    """
    from wattshelf.session import materialise

    placed = materialise(
        df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_place", 33))
    sizes = sorted((row["_part"], row["count"]) for row in placed.groupBy("_part").count().collect())
    starts, total = [], 0
    for part, size in sizes:
        starts.append((part, total))
        total += size
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part bigint, _start bigint")
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(output, F.col("_start") + within)
        .drop("_part", "_place", "_start")
    )
