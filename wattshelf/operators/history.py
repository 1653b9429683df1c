"""Prediction-history analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattshelf.functions.columns import quoted

NO_PREDICTIONS = "No predictions"
UNKNOWN_BRAND = "Unknown"


def history_kpis(predictions: DataFrame) -> DataFrame:
    """Total predictions, distinct categories and sub-categories (missing ones not counted)."""
    return predictions.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_distinct("predicted_category").alias("categories"),
        F.count_distinct("predicted_sub_category").alias("sub_categories"),
    )


def top_category(predictions: DataFrame, time: str = "timestamp") -> DataFrame:
    """The most frequent non-empty category, first seen wins; a default when there is none."""
    ranked = (
        predictions.filter(F.col("predicted_category") != "")
        .groupBy("predicted_category")
        .agg(F.count(F.lit(1)).alias("rows"), F.min(quoted(time)).alias("first_seen"))
    )
    best = F.max_by("predicted_category", F.struct(F.col("rows"), F.col("last"))).alias("top")
    # Later first appearance must lose: order by the negated time.
    ordered = ranked.withColumn("last", -F.timestamp_diff("MICROSECOND", _epoch(), F.col("first_seen").cast("timestamp_ntz")))
    return ordered.agg(best).select(F.coalesce("top", F.lit(NO_PREDICTIONS)).alias("top_category"))


def _epoch():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def recent_predictions(predictions: DataFrame, n: int = 10, time: str = "timestamp") -> DataFrame:
    return predictions.orderBy(F.desc(time), F.desc("prediction_id")).limit(n)


def value_counts(predictions: DataFrame, column: str, output: str = "rows") -> DataFrame:
    """Rows per value, missing values dropped, most frequent first."""
    counted = predictions.filter(quoted(column).isNotNull()).groupBy(quoted(column).alias(column))
    return counted.agg(F.count(F.lit(1)).alias(output)).orderBy(F.desc(output), F.asc(column))


def brand_mix(history: DataFrame, brand: str = "brand") -> DataFrame:
    named = F.coalesce(F.nullif(quoted(brand), F.lit("")), F.lit(UNKNOWN_BRAND))
    return history.groupBy(named.alias("brand")).agg(F.count(F.lit(1)).alias("rows")).orderBy(
        F.desc("rows"), F.asc("brand")
    )


def confidence_series(predictions: DataFrame, time: str = "timestamp") -> DataFrame:
    """Confidence in time order; the id splits equal times across sort partitions."""
    return predictions.select(time, "prediction_id", "confidence").orderBy(time, "prediction_id")


def category_values(predictions: DataFrame, column: str = "predicted_category") -> DataFrame:
    return predictions.select(column).filter(quoted(column).isNotNull()).distinct().orderBy(column)


def models_list(models: DataFrame) -> DataFrame:
    return models.select("version", "accuracy", "created_at").orderBy(F.desc("created_at"), F.asc("version"))


def enriched_predictions(predictions: DataFrame, products: DataFrame) -> DataFrame:
    """Each prediction with its product. No hint: Spark broadcasts products only below its size limit."""
    product = products.select(
        F.col("id").alias("product_id"), "product_name", "description", "brand", "price"
    )
    return predictions.join(product, "product_id")


def windowed_category_counts(
    predictions: DataFrame,
    time: str = "timestamp",
    window: str = "15 minutes",
    watermark: str | None = None,
) -> DataFrame:
    """Rows and mean confidence per window and category; with a watermark on a stream."""
    source = predictions.withWatermark(time, watermark) if watermark else predictions
    slot = F.window(quoted(time), window)
    return (
        source.groupBy(slot.alias("w"), F.col("predicted_category"))
        .agg(F.count(F.lit(1)).alias("rows"), F.avg("confidence").alias("mean_confidence"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "predicted_category",
            "rows",
            "mean_confidence",
        )
    )


def history_cube(history: DataFrame, columns: Sequence[str], measure: str = "confidence") -> DataFrame:
    """Rows and total of a measure for every combination of the columns, in one pass: columns, grouping_id, rows, total.

    ``grouping_id`` has a bit per column, the first one highest, set where the column is summed over; that tells a total
    from a missing value.
    """
    return history.cube(*[quoted(c) for c in columns]).agg(
        F.grouping_id().cast("bigint").alias("grouping_id"), F.count(F.lit(1)).alias("rows"), F.sum(quoted(measure)).alias("total")
    )


def daily_sketches(predictions: DataFrame, key: str, measure: str, time: str = "timestamp", k: int = 400) -> DataFrame:
    """(day, rows, keys, values): per day an HLL sketch of the distinct keys and a KLL sketch of the measure.

    Stored by day, they answer for any span of days without a look at the rows.
    """
    return predictions.groupBy(F.to_date(quoted(time)).alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(quoted(key), 14).alias("keys"), F.kll_sketch_agg_double(quoted(measure).cast("double"), k).alias("values")
    )


def merged_kpis(sketches: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Days, rows, estimated distinct keys and quantiles of all given days, from their sketches alone."""
    merged = sketches.agg(
        F.count(F.lit(1)).alias("days"), F.sum("rows").alias("rows"), F.hll_union_agg("keys").alias("_keys"), F.kll_merge_agg_double("values").alias("_values")
    )
    return merged.select(
        "days", "rows", F.hll_sketch_estimate("_keys").alias("distinct_keys"),
        F.array(*[F.kll_sketch_get_quantile_double("_values", F.lit(share)) for share in shares]).alias("quantiles"),
    )
