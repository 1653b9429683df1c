"""Splits, class guards, label weights and the content fingerprint."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattshelf.functions.columns import hash_position, quoted, row_digest
from wattshelf.functions.series import micros
from wattshelf.operators.ranks import broadcast_if_small, hits_at_ranks, values_at_ranks
from wattshelf.session import materialise

MIN_BUCKETS, MAX_BUCKETS = 4096, 1 << 20
ROWS_PER_BUCKET = 100_000


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(quoted(label).alias("label")).agg(F.count(F.lit(1)).alias("rows"))


def label_profile(df: DataFrame, label: str) -> DataFrame:
    """Rows, classes and the smallest class; ``trainable`` needs two classes."""
    return (
        label_counts(df, label)
        .filter(F.col("label").isNotNull())
        .agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"),
            F.count(F.lit(1)).alias("class_count"),
            F.min("rows").alias("smallest_class"),
        )
        .withColumn("trainable", F.col("class_count") >= 2)
    )


def can_stratify(df: DataFrame, label: str, test_share: float) -> DataFrame:
    """One row: every class has two rows, and both parts have a row for each class."""
    test_rows = F.ceil(F.col("row_count") * F.lit(float(test_share)))
    return label_profile(df, label).select(
        "row_count",
        "class_count",
        "smallest_class",
        test_rows.cast("bigint").alias("test_rows"),
        (F.col("row_count") - test_rows).cast("bigint").alias("train_rows"),
        (
            (F.col("smallest_class") >= 2)
            & (test_rows >= F.col("class_count"))
            & (F.col("row_count") - test_rows >= F.col("class_count"))
        ).alias("stratify"),
    )


def test_quotas(counts: dict[str, int], test_rows: int) -> dict[str, int]:
    """Test rows per class by largest remainder, ties in label order; they add up exactly."""
    total = sum(counts.values())
    quotas = {label: rows * test_rows // total for label, rows in counts.items()}
    by_remainder = sorted(counts, key=lambda label: (-(counts[label] * test_rows % total), label))
    for label in by_remainder[: test_rows - sum(quotas.values())]:
        quotas[label] += 1
    return quotas


def train_test_split(
    df: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = 42, output: str = "split"
) -> DataFrame:
    """Mark each row ``train`` or ``test``; stratified by label where that is possible.

    Rows are taken in seeded hash order of a unique key. Histograms of the hash locate the cut
    of each label; the rows themselves are neither sorted nor shuffled by label, so one large
    class costs no more than many small ones.
    """
    counts = {row["label"]: row["rows"] for row in label_counts(df, label).collect()}
    if None in counts:
        raise ValueError(f"column {label} has rows without a label")
    rows = sum(counts.values())
    test_rows = math.ceil(rows * test_share)
    stratify = (
        min(counts.values(), default=0) >= 2
        and test_rows >= len(counts)
        and rows - test_rows >= len(counts)
    )
    placed = df.withColumn("_position", hash_position(quoted(key), seed))
    if not stratify:
        cut = values_at_ranks(placed, {"_position": [test_rows]})["_position"][0]
        is_test = F.lit(True) if cut is None else F.col("_position") < F.lit(cut)
    else:
        quotas = test_quotas(counts, test_rows)
        wanted = df.sparkSession.createDataFrame(list(quotas.items()), "_label string, _quota bigint")
        cuts = broadcast_if_small(_label_cuts(placed, label, wanted, counts), len(counts))
        placed = placed.join(cuts, quoted(label) == F.col("_label"), "left").drop("_label")
        is_test = F.coalesce(F.col("_position") <= F.col("_cut"), F.lit(False))
    return placed.withColumn(output, F.when(is_test, "test").otherwise("train")).drop("_position", "_cut")


def hash_buckets(largest: int) -> int:
    """A power of two that leaves a bucket of the largest label small enough for a task."""
    return min(MAX_BUCKETS, max(MIN_BUCKETS, 1 << (largest // ROWS_PER_BUCKET).bit_length()))


def _label_cuts(placed: DataFrame, label: str, quotas: DataFrame, counts: Mapping[str, int]) -> DataFrame:
    """The largest test position of each label with a quota above zero: one row per label at most."""
    labels = len(counts)
    bucket = F.floor(F.col("_position") / F.lit(float(2**52 // hash_buckets(max(counts.values())))))
    keyed = placed.select(quoted(label).alias("_label"), "_position", bucket.alias("_bucket"))
    running = Window.partitionBy("_label").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    filled = (
        keyed.groupBy("_label", "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_upto", F.sum("_rows").over(running))
        .join(broadcast_if_small(quotas, labels), "_label")
    )
    edge = filled.filter(
        (F.col("_quota") > F.col("_upto") - F.col("_rows")) & (F.col("_quota") <= F.col("_upto"))
    ).select("_label", "_bucket", (F.col("_quota") - F.col("_upto") + F.col("_rows")).alias("_need"))
    within = Window.partitionBy("_label", "_bucket").orderBy("_position")
    return (
        keyed.join(broadcast_if_small(edge, labels), ["_label", "_bucket"])
        .withColumn("_n", F.row_number().over(within))
        .filter(F.col("_n") == F.col("_need"))
        .select("_label", F.col("_position").alias("_cut"))
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, rows, weight) with weight = n / (classes * rows of the class)."""
    counts = label_counts(df, label)
    mean_rows = label_counts(df, label).agg(F.sum("rows") / F.count(F.lit(1))).scalar()
    return counts.select("label", "rows", (mean_rows / F.col("rows")).alias("weight"))


def chronological_split(
    df: DataFrame,
    ts: Column,
    key: str,
    train_share: float = 0.70,
    validation_share: float = 0.85,
    output: str = "split",
    seed: int = 0,
) -> DataFrame:
    """Mark rows ``train`` / ``validation`` / ``test`` in time order, ties in hash order of ``key``.

    Two cut points are found from histograms; marking the rows is then a comparison.
    """
    placed = df.withColumns({"_at": micros(ts).cast("double"), "_position": hash_position(quoted(key), seed)})
    # The searches read two numbers a row, not the rows.
    narrow = materialise(placed.select("_at", "_position"), "split-order")
    n = narrow.count()
    train_end, validation_end = int(n * train_share), int(n * validation_share)
    if train_end == 0 or validation_end <= train_end or validation_end >= n:
        raise ValueError("not enough rows for a chronological split")
    ends = (train_end, validation_end)
    bounds = []
    for rank, hit in zip(ends, hits_at_ranks(narrow, {"_at": ends})["_at"], strict=True):
        if hit is None:
            raise ValueError("rows without a time cannot be split by time")
        position = None
        if hit.below < rank:  # the cut falls among rows of one time
            same_time = narrow.filter(F.col("_at") == F.lit(hit.value))
            position = values_at_ranks(same_time, {"_position": [rank - hit.below]})["_position"][0]
        bounds.append((hit.value, position))

    def before(bound: tuple[float, float | None]) -> Column:
        at, position = bound
        earlier = F.col("_at") < at
        return earlier if position is None else earlier | ((F.col("_at") == at) & (F.col("_position") < position))

    part = F.when(before(bounds[0]), "train").when(before(bounds[1]), "validation").otherwise("test")
    return placed.withColumn(output, part).drop("_at", "_position")


def dataset_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A SHA-256 of the rows' contents, the same in any order or partitioning.

    Row digests are summed, not xored, so pairs of equal rows do not cancel out.
    """
    digest = row_digest([quoted(name) for name in (columns or df.columns)])

    def part(start: int) -> Column:
        word = F.conv(F.substring("digest", start, 15), 16, 10).cast("decimal(38,0)")
        return F.coalesce(F.sum(word).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).cast("string")

    return (
        df.select(digest.alias("digest"))
        .agg(F.count(F.lit(1)).alias("row_count"), part(1).alias("_a"), part(16).alias("_b"))
        .select(
            "row_count",
            F.sha2(F.concat_ws(":", F.col("row_count").cast("string"), "_a", "_b"), 256).alias("fingerprint"),
        )
    )
