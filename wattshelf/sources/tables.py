"""Product, prediction and model tables: appends with ids, checks, upserts, feature files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattshelf.functions.columns import quoted
from wattshelf.operators.ranks import with_ordinals

PRODUCTS_SCHEMA = (
    "id bigint, product_name string, description string, brand string, price decimal(12,2), created_at timestamp"
)
PREDICTIONS_SCHEMA = (
    "prediction_id bigint, product_id bigint, predicted_category string, predicted_sub_category string, "
    "confidence decimal(6,5), timestamp timestamp"
)
LAST_IDS = "product_id bigint, prediction_id bigint"
MODELS_SCHEMA = "version string, accuracy decimal(6,5), created_at timestamp"


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stored rows; an empty frame before the first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def highest(existing: DataFrame, column: str) -> int:
    return existing.agg(F.coalesce(F.max(quoted(column)), F.lit(0)).cast("bigint").alias("m")).first()["m"]


def with_ids(new_rows: DataFrame, order: Column, output: str, after: int = 0) -> DataFrame:
    """Consecutive ids above ``after`` in source order; the same rows get the same ids on a retry."""
    return with_ordinals(new_rows, order, output="_n").withColumn(output, F.col("_n") + F.lit(after)).drop("_n")


def new_products(new_rows: DataFrame, order: Column, after: int = 0, created_at: Column | None = None) -> DataFrame:
    """Product rows in the shape of the table: id and time added, price to two decimals."""
    numbered = with_ids(new_rows, order, "id", after)
    return numbered.select(
        "id",
        "product_name",
        "description",
        "brand",
        F.col("price").cast("decimal(12,2)").alias("price"),
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
    )


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_predictions(df: DataFrame, path: str) -> None:
    """Append by day, sorted by category, so that day and category filters skip files."""
    dated = df.withColumn("day", F.to_date("timestamp"))
    dated.sortWithinPartitions("predicted_category", "predicted_sub_category").write.mode("append").partitionBy(
        "day"
    ).parquet(path)


def missing_products(predictions: DataFrame, products: DataFrame) -> DataFrame:
    """Predictions whose product does not exist."""
    known = products.select(F.col("id").alias("product_id"))
    return predictions.join(known, "product_id", "left_anti")


def confidence_violations(predictions: DataFrame, column: str = "confidence") -> DataFrame:
    return predictions.filter(~quoted(column).between(0, 1))


def upsert_models(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Insert new versions; for known ones replace the accuracy and keep the first time."""
    old = base.select("version", F.col("accuracy").alias("_a0"), F.col("created_at").alias("_t0"), F.lit(True).alias("_old"))
    new = updates.select("version", F.col("accuracy").alias("_a1"), F.col("created_at").alias("_t1"), F.lit(True).alias("_new"))
    return old.join(new, "version", "full_outer").select(
        "version",
        F.when(F.col("_new"), F.col("_a1")).otherwise(F.col("_a0")).alias("accuracy"),
        F.when(F.col("_old"), F.col("_t0")).otherwise(F.col("_t1")).alias("created_at"),
    )


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """The newest generation of the stored model versions."""
    stored = read_table(spark, path, f"{MODELS_SCHEMA}, generation bigint")
    return stored.filter(F.col("generation") == F.lit(highest(stored, "generation"))).drop("generation")


def store_models(updates: DataFrame, path: str) -> DataFrame:
    """Upsert into the stored table. The result is a new generation next to the old one, so a
    failed write leaves the old table as it was."""
    spark = updates.sparkSession
    stored = read_table(spark, path, f"{MODELS_SCHEMA}, generation bigint")
    following = highest(stored, "generation") + 1
    merged = upsert_models(read_models(spark, path), updates)
    merged.select(
        "version", F.col("accuracy").cast("decimal(6,5)").alias("accuracy"), "created_at"
    ).write.mode("overwrite").parquet(f"{path.rstrip('/')}/generation={following}")
    return read_models(spark, path)


def write_scored_batch(
    batch: DataFrame, batch_id: int, order: Column, products_path: str, predictions_path: str
) -> tuple[DataFrame, DataFrame]:
    """Store the products of a scored batch and their predictions, and return both.

    Each batch owns one partition of either table and replaces it when it is written again,
    so a failed or repeated batch leaves no half and no double rows. Ids follow those of the
    earlier batches, so a repeated batch gets the same ids.
    """
    spark = batch.sparkSession
    product_max, prediction_max = last_ids(spark, batch_id, products_path, predictions_path)
    numbered = with_ordinals(batch, order, output="_n")
    now = F.current_timestamp()
    products = numbered.select(
        (F.col("_n") + product_max).alias("id"),
        "product_name",
        "description",
        "brand",
        F.col("price").cast("decimal(12,2)").alias("price"),
        now.alias("created_at"),
    )
    predictions = numbered.select(
        (F.col("_n") + prediction_max).alias("prediction_id"),
        (F.col("_n") + product_max).alias("product_id"),
        "predicted_category",
        "predicted_sub_category",
        F.col("confidence").cast("decimal(6,5)").alias("confidence"),
        now.alias("timestamp"),
    )
    for rows, path in ((products, products_path), (predictions, predictions_path)):
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
    stored = (
        spark.read.parquet(f"{products_path.rstrip('/')}/batch_id={batch_id}"),
        spark.read.parquet(f"{predictions_path.rstrip('/')}/batch_id={batch_id}"),
    )
    added = stored[1].count()
    row = [(product_max + added, prediction_max + added)]
    spark.createDataFrame(row, LAST_IDS).coalesce(1).write.mode("overwrite").parquet(f"{ids_path(predictions_path)}/batch_id={batch_id}")
    return stored


def ids_path(predictions_path: str) -> str:
    """Where a batch leaves its last ids; readers of the table skip names with an underscore."""
    return f"{predictions_path.rstrip('/')}/_last_ids"


def last_ids(spark: SparkSession, batch_id: int, products_path: str, predictions_path: str) -> tuple[int, int]:
    """The last product and prediction id of the batches before ``batch_id``: one stored row per batch.

    Tables of batches that left no such row are searched once.
    """
    owner = "batch_id bigint"
    earlier = F.col("batch_id") < F.lit(batch_id)
    ids = read_table(spark, ids_path(predictions_path), f"{LAST_IDS}, {owner}").filter(earlier)
    row = ids.agg(F.max("product_id"), F.max("prediction_id")).first()
    if row[0] is not None:
        return row[0], row[1]
    products = read_table(spark, products_path, f"{PRODUCTS_SCHEMA}, {owner}").filter(earlier)
    predictions = read_table(spark, predictions_path, f"{PREDICTIONS_SCHEMA}, {owner}").filter(earlier)
    return highest(products, "id"), highest(predictions, "prediction_id")


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int = 16, partition_by: Sequence[str] = ()) -> None:
    """A table with rows dealt to buckets by ``key`` and sorted inside them: the stand-in for an index on the key.

    Tables with the same number of buckets join on the key without a shuffle; a filter on the key reads one bucket, and one on a
    partition column, also one that a join implies, reads its folders only.
    """
    columns = [quoted(name) for name in partition_by]
    dealt = df.repartition(buckets, quoted(key)) if not columns else df.repartition(buckets, *columns, quoted(key))
    writer = dealt.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key)
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(table)


def write_features(features: DataFrame, vocabulary: DataFrame, path: str) -> dict[str, str]:
    """The sparse matrix and the fitted vocabulary as Parquet."""
    paths = {"features": f"{path.rstrip('/')}/features", "vocabulary": f"{path.rstrip('/')}/vocabulary"}
    features.write.mode("overwrite").parquet(paths["features"])
    vocabulary.write.mode("overwrite").parquet(paths["vocabulary"])
    return paths
