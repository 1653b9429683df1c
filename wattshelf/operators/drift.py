"""Population stability, prediction summaries, delayed-label performance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattshelf.functions.columns import finite, null_if_nan, quoted
from wattshelf.functions.fixed_values import PSI_BUCKETS, PSI_FLOOR, PSI_THRESHOLD
from wattshelf.operators.metrics import regression_metrics
from wattshelf.operators.ranks import exact_quantiles


def reference_bins(
    reference: DataFrame, columns: Sequence[str], buckets: int = PSI_BUCKETS
) -> dict[str, list[float]]:
    """Quantile break points per column; equal bins where fewer than three differ."""
    quantiles, profiles = exact_quantiles(reference, columns, [i / buckets for i in range(buckets + 1)])
    bins = {}
    for name in columns:
        if not profiles[name].count:
            raise ValueError(f"no finite reference value in {name}")
        breaks = sorted(set(quantiles[name]))
        if len(breaks) < 3:
            breaks = equal_bins(profiles[name].low, profiles[name].high, buckets)
        bins[name] = breaks
    return bins


def equal_bins(low: float, high: float, buckets: int = PSI_BUCKETS) -> list[float]:
    width = (high + 1e-6 - low) / buckets
    return [low + i * width for i in range(buckets)] + [high + 1e-6]


def bin_of(value: Column, breaks: Sequence[float]) -> Column:
    """0-based bin ``[a, b)``, the last one closed; null outside the range."""
    at_or_above = [(value >= F.lit(b)).cast("int") for b in breaks[:-1]]
    index = sum(at_or_above[1:], at_or_above[0]) - 1
    return F.when(value.between(F.lit(breaks[0]), F.lit(breaks[-1])), index)


def binned(df: DataFrame, bins: Mapping[str, Sequence[float]], keep: Sequence[Column] = ()) -> DataFrame:
    """(column, bin) cells of every row; values outside the reference range are dropped."""
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("column"), bin_of(finite(quoted(name)), breaks).alias("bin"))
            for name, breaks in bins.items()
        ]
    )
    spread = df.select(*keep, F.explode(cells).alias("cell"))
    kept = [name for name in spread.columns if name != "cell"]
    return spread.filter(F.col("cell.bin").isNotNull()).select(*kept, "cell.*")


def histogram(df: DataFrame, bins: Mapping[str, Sequence[float]], output: str = "rows") -> DataFrame:
    """Rows per (column, bin), every bin present."""
    counts = binned(df, bins).groupBy("column", "bin").agg(F.count(F.lit(1)).alias(output))
    frame = bin_frame(df, bins)
    return (
        frame.join(counts, ["column", "bin"], "left")
        .withColumn(output, F.coalesce(output, F.lit(0)).cast("bigint"))
    )


def bin_frame(df: DataFrame, bins: Mapping[str, Sequence[float]]) -> DataFrame:
    """(column, bin, low, high): one row per bin."""
    rows = [
        (name, i, float(breaks[i]), float(breaks[i + 1]))
        for name, breaks in bins.items()
        for i in range(len(breaks) - 1)
    ]
    return df.sparkSession.createDataFrame(rows, "column string, bin int, low double, high double")


def psi_from_counts(counts: DataFrame, groups: Sequence[str] = ("column",)) -> DataFrame:
    """PSI per group from (bin, expected, actual) counts; shares have a floor."""
    # A group holds one row per bin, so the window is as small as the bin list.
    group = Window.partitionBy(*groups)

    def share(side: str) -> Column:
        total = F.greatest(F.sum(side).over(group), F.lit(1))
        return F.greatest(F.col(side) / total, F.lit(PSI_FLOOR)).alias(side)

    shares = counts.select(*groups, share("expected"), share("actual"))
    expected, actual = F.col("expected"), F.col("actual")
    return shares.groupBy(*groups).agg(F.sum((actual - expected) * F.log(actual / expected)).alias("psi"))


def drift_report(
    reference: DataFrame,
    current: DataFrame,
    columns: Sequence[str],
    threshold: float = PSI_THRESHOLD,
    buckets: int = PSI_BUCKETS,
) -> DataFrame:
    """(column, psi, drifted, threshold), all columns in one grouped job per side."""
    usable = current.agg(*[F.count(finite(quoted(name))).alias(f"n{i}") for i, name in enumerate(columns)]).first()
    for i, name in enumerate(columns):
        if not usable[f"n{i}"]:
            raise ValueError(f"no finite current value in {name}")
    bins = reference_bins(reference, columns, buckets)
    counts = histogram(reference, bins, "expected").join(
        histogram(current, bins, "actual").drop("low", "high"), ["column", "bin"]
    )
    return psi_from_counts(counts).withColumns(
        {"drifted": F.col("psi") >= F.lit(threshold), "threshold": F.lit(threshold)}
    )


def windowed_counts(df: DataFrame, ts: str, bins: Mapping[str, Sequence[float]], window: str) -> DataFrame:
    """Rows per (window start, column, bin); works on batch and streaming frames."""
    # The window struct itself is grouped: a stream keeps its watermark only on that column.
    cells = binned(df, bins, [F.window(quoted(ts), window).alias("_w")])
    counts = cells.groupBy("_w", "column", "bin").agg(F.count(F.lit(1)).alias("actual"))
    return counts.select(F.col("_w.start").alias("window_start"), "column", "bin", "actual")


def windowed_psi(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """PSI per (window, column) of windowed counts against the reference histogram."""
    # Lists of at most one entry per bin: all bins of a window, and those that it filled.
    found = counts.groupBy("window_start", "column").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "actual"))).alias("found")
    )
    wanted = expected.groupBy("column").agg(F.collect_list(F.struct("bin", "expected")).alias("wanted"))
    cells = (
        found.join(F.broadcast(wanted), "column")
        .select("window_start", "column", "found", F.explode("wanted").alias("w"))
        .select(
            "window_start",
            "column",
            "w.expected",
            F.coalesce(F.element_at("found", F.col("w.bin")), F.lit(0)).alias("actual"),
        )
    )
    return psi_from_counts(cells, ["window_start", "column"])


def prediction_summary(df: DataFrame, prediction: str, groups: Sequence[str] = ()) -> DataFrame:
    """Count, mean, population deviation, min and max of the non-missing predictions."""
    value = null_if_nan(quoted(prediction).cast("double"))
    measures = [
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]
    return df.groupBy(*groups).agg(*measures) if groups else df.agg(*measures)


def delayed_label_performance(
    predictions: DataFrame, labels: DataFrame, key: str, prediction: str, actual: str
) -> DataFrame:
    """Regression metrics of the predictions whose label has arrived."""
    matched = predictions.select(key, prediction).join(labels.select(key, actual), key)
    return regression_metrics(matched, actual, prediction)


def feature_summary(df: DataFrame) -> DataFrame:
    """(column, missing_rate, mean, std) for numeric columns, one pass over the rows."""
    names = [field.name for field in df.schema.fields if isinstance(field.dataType, T.NumericType)]
    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, name in enumerate(names):
        value = null_if_nan(quoted(name).cast("double"))
        aggregates += [
            F.count(value).alias(f"c{i}"),
            F.avg(value).alias(f"m{i}"),
            F.stddev_pop(value).alias(f"s{i}"),
        ]
    return df.agg(*aggregates).select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("column"),
                        F.try_divide(F.col("n") - F.col(f"c{i}"), F.col("n")).alias("missing_rate"),
                        F.col(f"m{i}").alias("mean"),
                        F.col(f"s{i}").alias("std"),
                    )
                    for i, name in enumerate(names)
                ]
            )
        ).alias("s")
    ).select("s.*")
